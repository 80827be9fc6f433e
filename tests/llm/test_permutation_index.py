import numpy as np
import odd
from pyspark.sql import functions as F

from gradewell.llm.permutation_index import nearest
from gradewell.llm.queries import op6_permutation_index

EVERY_20TH = "pmod(vec_id, 20) = 0"


def brute(rows, k, asked):
    ok = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, v in ok:
        if asked(q):
            scores = sorted((-float((np.array(v) * np.array(w)).sum()), i) for i, w in ok if i != q and len(w) == len(v))
            out.setdefault(q, []).append(scores[:k])
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


def test_recall_and_exact_scores(spark):
    folder = "/root/testdata/sf0.1"
    rows = odd.table(folder, "embeddings", "vec_id, embedding")
    wanted, got = brute(rows, 20, lambda q: q % 20 == 0), found(op6_permutation_index(spark, folder))
    vectors = {i: np.array(v, float) for i, v in rows}
    hits = 0
    for q, (best,) in wanted.items():
        assert [r for r, _, _ in got[q]] == list(range(1, 21))
        assert got[q] == sorted(got[q], key=lambda x: (-x[2], x[1]))
        assert all(abs(s - vectors[q] @ vectors[i]) < 1e-12 for _, i, s in got[q])
        hits += len({i for _, i, _ in got[q]} & {i for _, i in best})
    assert set(got) == set(wanted) and hits >= 0.9 * 20 * len(wanted)


def test_all_candidates_are_reranked_where_they_are_few(spark):
    """Ties, copies, unequal lengths, unusable vectors and repeated rows; a shard this small is searched whole."""
    rng = np.random.default_rng(7)
    base = [[float(x) for x in v] for v in rng.normal(size=(25, 6)) * rng.uniform(0.2, 5, (25, 1))]
    rows = [(i, base[i % 25]) for i in range(90)]
    rows += [(100, None), (120, []), (140, [0.0] * 6), (160, [1.0, float("nan"), 0.0, 0.0, 0.0, 0.0]), (180, [None, 1.0, 0.0, 0.0, 0.0, 0.0])]
    rows += [(200, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0]), (None, base[0]), (0, base[0]), (-20, [1.0, 2.0]), (3, [2.0, 1.0]), (220, [5.0]), (40, base[3])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id bigint, embedding array<double>, pivots string, score int")
    wanted = brute(rows, 20, lambda q: q % 20 == 0)
    got = found(nearest(df, 20, query=F.expr(EVERY_20TH)))
    assert set(got) == {q for q, lists in wanted.items() if any(lists)}
    for q, lists in wanted.items():
        mine = sorted((round(s, 9), i) for _, i, s in got.get(q, []))
        assert mine == sorted((round(-s, 9), i) for best in lists for s, i in best), q
    assert nearest(df.limit(0), 20).count() == 0


def test_blocks_of_queries_are_searched_one_by_one(spark, monkeypatch):
    """What a block finds is written before the next one: the result only reads it, whatever the number of blocks."""
    from gradewell.llm import permutation_index

    monkeypatch.setattr(permutation_index, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(11)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(60, 6)))]
    rows += [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(30, 3)))]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    near = nearest(df, 5, query=F.expr("pmod(vec_id, 3) = 0"))
    assert "MapInArrow" not in near._jdf.queryExecution().toString()
    wanted, got = brute(rows, 5, lambda q: q % 3 == 0), found(near)
    assert set(got) == set(wanted)
    for q, lists in wanted.items():
        mine = sorted((round(s, 9), i) for _, i, s in got[q])
        assert mine == sorted((round(-s, 9), i) for best in lists for s, i in best), q


def test_recall_at_the_share_of_full_shards(spark):
    """Without the least number of candidates, which searches small shards more fully."""
    folder = "/root/testdata/sf0.1"
    wanted = brute(odd.table(folder, "embeddings", "vec_id, embedding"), 20, lambda q: q % 20 == 0)
    got = found(nearest(spark.read.parquet(f"{folder}/embeddings.parquet"), 20, query=F.expr(EVERY_20TH), least=1))
    hits = sum(len({i for _, i, _ in got[q]} & {i for _, i in best}) for q, (best,) in wanted.items())
    print("recall", hits / (20 * len(wanted)))
    assert set(got) == set(wanted) and hits >= 0.9 * 20 * len(wanted)
