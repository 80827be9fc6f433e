import odd
import pytest
import xxhash

from gradewell.llm.graph import components
from gradewell.llm.queries import op9_simhash
from gradewell.llm.simhash import first_of_each_group, near_duplicates, near_pairs

SMALL = "/root/testdata/sf0.001"


def fingerprint(text, size=3):
    w = odd.words(text)
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + size]).encode(), 42) for i in range(max(1, len(w) - size + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_of(rows, bits=2):
    prints = [fingerprint(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= bits]
    return prints, odd.components(len(rows), pairs)


def expected(rows, bits=2):
    prints, group = groups_of(rows, bits)
    named = {g: min((i for (i, _), x in zip(rows, group) if x == g and i is not None), default=None) for g in set(group)}
    return sorted(((i, f"{p:016x}", named[g]) for (i, _), p, g in zip(rows, prints, group)), key=repr)


def result(df):
    return sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in df.collect()), key=repr)


def test_whole_table(spark):
    assert result(op9_simhash(spark, SMALL)) == expected(odd.table(SMALL, "documents", "doc_id, text"))


def test_odd_rows(spark):
    assert result(near_duplicates(odd.documents(spark))) == expected([r[:2] for r in odd.rows()])
    assert near_duplicates(odd.nothing(spark)).count() == 0


def test_one_of_each_group_stays(spark):
    kept = first_of_each_group(odd.documents(spark))
    assert kept.columns == odd.documents(spark).columns
    rows = [r[:2] for r in odd.rows()]
    stays = {(i, p) for i, p, g in expected(rows) if i == g}
    found = [(r["doc_id"], f"{fingerprint(r['text']):016x}") for r in kept.collect()]
    assert len(found) == len(set(groups_of(rows)[1])) and set(found) <= stays
    assert first_of_each_group(odd.nothing(spark)).count() == 0
    alone = spark.createDataFrame([(None, "a b c d"), (None, "a b c d")], "doc_id bigint, text string")
    assert first_of_each_group(alone).count() == 1


@pytest.mark.parametrize("tile", [1_024, 3])
def test_pairs_of_a_dense_cluster(spark, tile, monkeypatch):
    from gradewell.llm import graph

    monkeypatch.setattr(graph.bucket_links, "__defaults__", (tile,))
    centre = 0x0F0F33335555AAAA
    prints = sorted({centre ^ (1 << a) ^ (1 << b) ^ (1 << c) for a in range(0, 60, 7) for b in range(1, 64, 9) for c in (0, 5)} | {7, 3 << 40})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = near_pairs(spark.createDataFrame([(p,) for p in signed], "fp bigint"))
    found = {r["node"]: r["component"] for r in components(links).collect()}
    group = odd.components(len(prints), [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2])
    mine = {}
    for p, g in zip(signed, group):
        mine.setdefault(g, []).append(p)
    for members in mine.values():
        assert {found.get(p, p) for p in members} == {min(members)}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(5, 5), (-3, 100), (200, 201), (201, 200)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {i: 0 for i in range(61)} | {i: -3 for i in [-3, *range(100, 160)]} | {200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
