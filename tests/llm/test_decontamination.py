import odd

from gradewell.llm.decontamination import contained_items, without_items
from gradewell.llm.queries import op4_decontamination

SMALL = "/root/testdata/sf0.001"


def shingles(text, size=5):
    w = odd.words(text)
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def expected(docs, items, threshold=0.8):
    merged = {}
    for i, t in items:
        if odd.words(t):
            merged.setdefault(tuple(odd.words(t)), []).append(i)
    out = []
    for d, text in docs:
        there = shingles(text)
        for w, ids in merged.items():
            mine = shingles(" ".join(w))
            shared = len(mine & there)
            if shared >= threshold * len(mine):
                out.append((d, min((i for i in ids if i is not None), default=None), len(ids), shared, len(mine)))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r["doc_id"], r["item_id"], r["item_copies"], r["shared"], r["shingles"]) for r in df.collect()), key=repr)


def test_whole_table(spark):
    docs, items = odd.table(SMALL, "documents", "doc_id, text"), odd.table(SMALL, "benchmark", "item_id, text")
    wanted = expected(docs, items)
    assert len(wanted) >= 3 and result(op4_decontamination(spark, SMALL)) == wanted


def test_pieces_of_an_item_scattered_over_a_document(spark):
    item = " ".join(f"q{i}" for i in range(60))
    w = item.split()
    filler = [" ".join(f"f{k}x{i}" for i in range(150)) for k in range(8)]
    scattered = " ".join(x for k in range(4) for x in (filler[k], " ".join(w[15 * k : 15 * k + 19])))
    little = " ".join([filler[0], " ".join(w[:30]), filler[1]])
    docs = [(0, scattered), (1, little), (2, filler[0]), (3, " ".join(filler) + " " + item.upper() + " " + filler[0])]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    items = spark.createDataFrame([(5, item)], "item_id bigint, text string")
    assert result(contained_items(df, items)) == expected(docs, [(5, item)])
    assert [r["doc_id"] for r in without_items(df, items).collect()] == [1, 2]


def test_odd_rows_and_several_blocks(spark, monkeypatch):
    from gradewell.llm import decontamination

    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 300)
    df = odd.documents(spark)
    rows = [r[:2] for r in odd.rows()]
    items = [(1, odd.PROSE), (2, odd.PROSE.upper().replace(" ", "  \n")), (None, "one"), (4, "one two three four"), (5, None), (6, " "), (7, "de de de de de de"), (8, "not there at all in any of them")]
    table = spark.createDataFrame([(*r, "x", "y") for r in items], "item_id bigint, text string, doc_id string, shared string")
    assert result(contained_items(df, table)) == expected(rows, items)
    hit = {i for i, (d, t) in enumerate(rows) if expected([(d, t)], items)}
    kept = without_items(df, table)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == sorted(
        (d is None, d or 0, t or "") for i, (d, t) in enumerate(rows) if i not in hit
    )
    nobody = table.limit(0)
    assert contained_items(df, nobody).count() == 0 and without_items(df, nobody).count() == len(rows)
    assert contained_items(odd.nothing(spark), table).count() == 0 and without_items(odd.nothing(spark), table).count() == 0


def test_short_items_are_never_missed(spark):
    """Items of 5 to 19 words, 1 to 15 shingles, each whole inside one long document."""
    items = [(i, " ".join(f"i{i}x{k}" for k in range(5 + i % 15))) for i in range(450)]
    docs = [(i, " ".join([*(f"d{i}y{k}" for k in range(40 + i % 60)), text, *(f"d{i}z{k}" for k in range(90))])) for i, text in items]
    found = contained_items(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert result(found) == sorted(((i, i, 1, 1 + i % 15, 1 + i % 15) for i, _ in items), key=repr)
