import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest

from millrace.llm.storage import Work
from millrace.llm.tokens import Encoder, read_tokens, token_metadata, tokens_roundtrip, write_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "a   b", "a \n b", "a\n\n b", "a  b", "a  b", "don't  'tis it's", "é ñ　x 　 y", "x" * 3000, "1 22 333  4444", "<|endoftext|> a <|endoftext|>", "a<|endoftext|>b", "x  <|endoftext|>  y<|endoftext|><|endoftext|>", "<|endoftext", "\n<|endoftext|>\nz", "😀".encode("utf-16", "surrogatepass").decode("utf-16") + " smile", "tab\t\tx \t y", "line\r\n \r\nend \n", "\x1c \x1d a", "a " * 40_000]


def plain(texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


def test_encoder_equals_the_library(spark):
    texts = ODD + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rng = random.Random(5)
    texts += ["".join(rng.choice(["ab", " ", "\n", "<|endoftext|>", "<|", "|>", "é"]) for _ in range(rng.randint(0, 12))) for _ in range(2000)]
    texts += ["".join(rng.choice("ab Z.,'s\n\t 1é\u00a0\u3000×ß\u2028😀\u0301") for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    raw = [t.encode() for t in texts]
    enc = Encoder(PATH)
    for _ in range(2):
        ids, counts = enc.encode(np.cumsum([0, *map(len, raw)]), np.frombuffer(b"".join(raw), np.uint8))
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == plain(texts)


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_round_trip(spark, encoding):
    rows = [(int(i * 7 % 23), t) for i, t in enumerate(ODD)] + [(None, "no id"), (5, None), (5, None)]
    got = sorted(tokens_roundtrip(spark.createDataFrame(rows, "doc_id bigint, text string"), PATH, 2, encoding=encoding, parts=3).select("start", "doc_id", "n_tokens", "ids_crc32").collect())
    rows.sort(key=lambda r: (r[0] is not None, r[0], r[1] is not None, (r[1] or "").encode()))
    start = 0
    for g, (doc, _), ids in zip(got, rows, plain([t or "" for _, t in rows]), strict=True):
        ids = np.array([*ids, 2], "<u4")
        assert tuple(g) == (start, doc, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_files_have_indexes_and_selective_reads(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumnRenamed("source", "ids")
    path = Work(spark, "test").path("tokens")
    write_tokens(docs, path, PATH, 2, parts=2)
    plan = token_metadata(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "ids:array" not in plan
    import glob

    column = pq.ParquetFile(sorted(glob.glob(path.removeprefix("file://") + "/*.parquet"))[0]).metadata.row_group(0)
    assert all(column.column(i).has_offset_index for i in range(column.num_columns))
    assert any("DICTIONARY" in e for e in column.column(4).encodings)
    assert read_tokens(spark, path).where("doc_id = 7").count() == 1
    with pytest.raises(ValueError):
        write_tokens(docs, path, PATH, 2, encoding="plain")


def test_other_pre_tokenizers_encode_whole_texts(tmp_path):
    import json

    with open(PATH) as f:
        spec = json.load(f)
    spec["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "t.json").write_text(json.dumps(spec))
    enc, texts = Encoder(str(tmp_path / "t.json")), ["a b", "", " é <|endoftext|>x"]
    raw = [t.encode() for t in texts]
    ids, counts = enc.encode(np.cumsum([0, *map(len, raw)]), np.frombuffer(b"".join(raw), np.uint8))
    from tokenizers import Tokenizer

    want = [e.ids for e in Tokenizer.from_file(str(tmp_path / "t.json")).encode_batch(texts, add_special_tokens=False)]
    assert not enc.cuttable and [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want


def test_empty_table(spark):
    assert tokens_roundtrip(spark.createDataFrame([], "doc_id bigint, text string"), PATH, 2).count() == 0
