"""The queries as registered, over the smallest tables, against their SQL or plain Python over the same rows."""

import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import pytest

from siftline.llm import queries as Q
from test_pairs import brute

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for name in ("documents", "embeddings", "pages", "labels", "benchmark"):
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return c


def rows(spark, name):
    return Q.QUERIES[name](spark, SF).collect()


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_queries_equal_their_sql(spark, sql, name):
    got = Q.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = sql.sql(Q.ORACLES[name]).select(*columns).fetchall()
    assert Counter(map(repr, map(tuple, got.select(*columns).collect()))) == Counter(map(repr, want))


def test_op1_sql_on_awkward_documents(spark, documents, tmp_path):
    documents.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = Q.op1_quality_rules(spark, str(tmp_path))
    columns = sorted(got.columns)
    assert Counter(map(repr, map(tuple, got.select(*columns).collect()))) == Counter(map(repr, c.sql(Q.ORACLES["op1_quality_rules"]).select(*columns).fetchall()))


def test_op2_hosts_and_rules(spark, sql):
    listed = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}
    url = dict(sql.sql("SELECT page_id, url FROM pages").fetchall())
    got = rows(spark, "op2_url_filters")
    assert len(got) == len(url)
    for r in got:
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url[r.page_id] or "")
        host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
        fits = [x for x in listed if (host == x.split("/")[0] or host.endswith("." + x.split("/")[0])) and path.startswith("/" + x.split("/", 1)[1])]
        rule = max(fits, key=len, default=None)
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block") and (rule is None or r.verdict == listed[rule])


@pytest.mark.parametrize("name,by,is_", [("op3_language_id", 5, 0), ("op7_toxicity", 3, 1)])
def test_held_out_rows(spark, sql, name, by, is_):
    got = rows(spark, name)
    assert len(got) == sql.sql("SELECT count(*) FROM documents").fetchall()[0][0]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % by == is_) and 0 <= r.score <= 1 for r in got)
    if by == 5:
        lang = dict(sql.sql("SELECT doc_id, lang FROM documents WHERE lang IS NOT NULL AND regexp_matches(text, '\\p{L}')").fetchall())
        out = [r for r in got if r.held_out and r.doc_id in lang]
        assert sum(r.lang_pred == lang[r.doc_id] for r in out) >= 0.9 * len(out)
    else:
        assert all(r.predicted == (r.score >= 0.7) for r in got)


def test_op4_sizes_and_targets(spark, sql):
    docs = sql.sql("SELECT doc_id, text, source FROM documents").fetchall()
    size = {d: len(WORD.findall(t or "")) for d, t, _ in docs}
    total = Counter()
    for d, _, s in docs:
        total[s] += size[d]
    order = sorted(total, key=lambda s: (s is None, s or ""))
    target, open_, left = {}, list(order), Fraction(sum(total.values()))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    while open_:  # round by round: who is above three times its size stops there
        share = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if share * weight[s] > 3 * total[s]]
        target |= {s: Fraction(3 * total[s]) for s in over} if over else {s: share * weight[s] for s in open_}
        left -= sum(3 * total[s] for s in over)
        open_ = [s for s in open_ if s not in over] if over else []
    source, taken = {d: s for d, _, s in docs}, Counter()
    got = rows(spark, "op4_source_mixing")
    assert len(got) == len(docs)
    for r in got:
        s = source[r.doc_id]
        assert (r.size, r.source_size) == (size[r.doc_id], total[s]) and abs(r.target - float(target[s])) < 1e-6 and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 8 for s in order)


def test_op5_law(spark, sql):
    text = dict(sql.sql("SELECT doc_id, text FROM documents").fetchall())
    got = rows(spark, "op5_sharding")
    slots = defaultdict(list)
    for r in got:
        b = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(b) + 8, zlib.crc32(b), "rows", None) and 0 <= r.shard < 24
        slots[r.shard].append(r.slot)
    assert len(got) == len(text) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(map(len, slots.values())) - min(len(slots[s]) for s in range(24)) <= 1


def test_op9_equals_brute_force(spark, sql):
    docs = sql.sql("SELECT doc_id, text FROM documents").fetchall()
    assert sorted(map(tuple, rows(spark, "op9_jaccard_join")), key=str) == brute(docs, 4, 85)


def test_op6_and_op8_and_op10(spark, sql):
    bench = sql.sql("SELECT item_id, text FROM benchmark").fetchall()
    docs = sql.sql("SELECT doc_id, text FROM documents").fetchall()
    words = lambda t: " ".join(WORD.findall((t or "").lower()))
    exact = {(d, i) for d, t in docs for i, x in bench if words(x) and f" {words(x)} " in f" {words(t)} "}
    assert exact <= {(r.doc_id, r.item_id) for r in rows(spark, "op6_decontamination")}
    index = rows(spark, "op8_token_shards")
    assert sorted(r.slot for r in index) == list(range(len(index))) == sorted(r.sequence for r in index)
    got = rows(spark, "op10_quality_classifier")
    assert sorted(r.doc_id for r in got) == sorted(d for d, _ in docs) and all(0 <= r.tail <= 1 and r.kept == (r.tail >= 0.5) for r in got)
