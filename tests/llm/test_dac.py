"""Files of directly addressable codes: round trips, single ids, and the operator against the library."""

import io
import os
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyarrow import fs
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from tokenizers import Tokenizer  # noqa: E402

from dossier.llm import dac, queries  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")
SMALL = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977} the" for i in range(60_000))


class Memory:
    """A file in memory that counts the bytes read."""

    def __init__(self, data):
        self.data, self.read = data, 0

    def size(self):
        return len(self.data)

    def read_at(self, n, offset):
        self.read += n
        return self.data[offset: offset + n]


def written(docs):
    stream = io.BytesIO()
    close, stream.close = stream.close, lambda: None
    writer = dac.Writer(stream)
    for doc, ids in docs:
        writer.add(doc, np.array(ids, dtype=np.uint32))
    writer.close()
    data = stream.getvalue()
    close()
    return data


IDS = st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300) | st.integers(65_000, 66_000), max_size=1500)


@settings(max_examples=60, deadline=None)
@given(IDS)
def test_levels_round_trip(ids):
    ids = np.array(ids, dtype=np.uint32)
    levels = dac.encode(ids)
    assert dac.decode(levels).tolist() == ids.tolist()
    assert sum(len(chunks) for chunks, _, _ in levels) == sum(max(1, -(-int(i).bit_length() // 8)) for i in ids)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.none() | st.integers(-5, 2**62), IDS.filter(len)), max_size=12), st.sampled_from([512, 1024]))
def test_files_round_trip(docs, segment):
    before, dac.SEGMENT = dac.SEGMENT, segment
    try:
        file = Memory(written(docs))
    finally:
        dac.SEGMENT = before
    reader = dac.Reader(file)
    want, start = [], 0
    for doc, ids in docs:
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert list(reader.documents()) == want and len(reader) == start
    every = [i for _, ids in docs for i in ids]
    for k in {*range(0, start, 37), *range(max(0, start - 3), start)}:
        assert reader[k] == every[k]
    with pytest.raises(IndexError):
        reader[start]


def test_one_id_reads_few_bytes():
    ids = np.random.default_rng(1).integers(0, 49_000, 200_000)
    file = Memory(written([(1, ids)]))
    reader = dac.Reader(file)
    for k in (0, 511, 512, 77_777, 199_999):
        file.read = 0
        assert reader[k] == ids[k] and file.read < 200


def plain(rows):
    tokenizer, out, start = Tokenizer.from_file(PATH), [], 0
    for doc, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_equals_the_library(spark, tmp_path):
    rows = [(9, "one"), (3, LONG), (None, None), (5, ""), (4, " \n\t "), (7, "É́É ﬁ <|endoftext|> it's 12345 日本語  x"), (6, "same"), (6, "same"), (10**15, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit("own").alias(c) for c in ("hash", "number", "part", "path", "start")])
    parts = dac.write(df, f"{tmp_path}/files", PATH)
    want = plain(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)))
    assert [(p.start, p.n_docs) for p in parts][0] == (0, parts[0].n_docs) and sum(p.n_docs for p in parts) == len(rows)
    assert sorted(map(str, map(tuple, dac.read(spark, parts).collect()))) == sorted(map(str, want))
    ids = Tokenizer.from_file(PATH).encode(LONG, add_special_tokens=False).ids
    start = next(s for d, s, *_ in want if d == 3)
    assert [dac.token(parts, start + k) for k in (0, 5, 70_000)] == [ids[k] for k in (0, 5, 70_000)]
    assert dac.token(parts, start + len(ids)) == dac.END
    assert len(os.listdir(f"{tmp_path}/files")) == len(parts)
    dac.remove(f"{tmp_path}/files")
    assert not os.path.exists(f"{tmp_path}/files")


def test_an_empty_table_has_no_files(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    parts = dac.write(df, f"{tmp_path}/files", PATH)
    assert parts == [] and dac.read(spark, parts).count() == 0


def test_a_failed_task_leaves_no_second_copy(spark, tmp_path):
    """A file that no task listed is not read."""
    df = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    parts = dac.write(df, f"{tmp_path}/files", PATH)
    with fs.LocalFileSystem().open_output_stream(f"{tmp_path}/files/left-over.dac") as stream:
        stream.write(b"cut off")
    assert dac.read(spark, parts).count() == 50


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_query_equals_the_library(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = queries.op12_token_files(spark, SMALL).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == sorted(plain(map(tuple, rows)))
