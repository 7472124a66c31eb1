import zlib

import numpy as np
import pytest

from siftline.llm import token_shards as T

pytestmark = pytest.mark.skipif(not __import__("os").path.exists(T.VOCABULARY), reason="no vocabulary file")


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_slots_are_a_permutation(n):
    got = T.slots(np.arange(n), n, 77)
    assert sorted(got.tolist()) == list(range(n))
    assert n < 50 or (got != T.slots(np.arange(n), n, 78)).any()


def test_round_trip(spark, documents, tmp_path):
    docs = documents.filter("doc_id is not null")
    index, layout = T.write_shards(docs, path=str(tmp_path / "out"), length=64, per_shard=100)
    assert T.read_layout(spark, layout.path) == layout
    rows = {r.slot: r for r in index.collect()}
    assert sorted(rows) == list(range(layout.sequences))
    read = T.read_slots(spark, layout, 0, layout.sequences).collect()
    assert [r.slot for r in read] == list(range(layout.sequences))
    order = [None] * layout.sequences
    for r in read:
        x = rows[r.slot]
        assert zlib.crc32(bytes(r.tokens)) == x.tokens_crc32 and x.shard == r.slot // 100 and x.byte_offset == r.slot % 100 * layout.stride
        order[x.sequence] = np.frombuffer(bytes(r.tokens), "<u2")[: x.n_tokens]
    coder = T.encoding(open(T.VOCABULARY, "rb").read(), T.PATTERN)
    ids = np.concatenate(order)
    texts = [coder.decode(x[:-1].tolist()) for x in np.split(ids, np.flatnonzero(ids == T.END) + 1)[:-1]]
    assert sorted(texts) == sorted(r.text for r in docs.collect() if r.text is not None)
    part = T.read_slots(spark, layout, 150, 260).collect()
    assert [(r.slot, r.tokens) for r in part] == [(r.slot, r.tokens) for r in read[150:260]]
    again, _ = T.write_shards(docs, path=str(tmp_path / "again"), length=64, per_shard=100)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows.values()))


def test_nothing_to_write(spark, empty, tmp_path):
    index, layout = T.write_shards(empty, path=str(tmp_path / "out"))
    assert index.count() == 0 and layout.sequences == 0


def test_ids_of_other_types_and_null_ones(spark, tmp_path):
    for cast in ("decimal(9, 0)", "string", "int"):
        docs = spark.createDataFrame([(None, "one two"), (None, None), (3, "")], "doc_id long, text string").selectExpr(f"cast(doc_id as {cast}) as doc_id", "text", "1 as slot").coalesce(1)
        index, layout = T.write_shards(docs, path=str(tmp_path / cast[:3]), length=4)
        got = index.collect()
        assert len(got) == layout.sequences == 1 and got[0].first_doc_id is None and got[0].n_docs == 2
