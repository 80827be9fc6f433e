"""Small documents with everything that is awkward, and plain-Python forms to compare with."""

import re

import duckdb

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASHES = "key bigint, component_id string, length string, n string, rank string, pivots string, blocks string, row string, a string, spans string"
SCHEMA = f"doc_id bigint, text string, lang string, n_chars bigint, {CLASHES}"
PROSE = (
    "Once there was a small town by the river where every morning the baker, the smith and the weaver met to talk about the "
    "weather, the prices of flour and iron, and the long road that led over the hills to the city. "
)


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def words(text):
    return WORD.findall(lower(text))


def rows():
    long = " ".join(f"w{i % 997}x{i % 89}" for i in range(60_000))
    texts = [
        (None, None), (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one two three four"), (6, PROSE * 4), (6, PROSE * 4),
        (7, PROSE * 4), (None, PROSE * 4), (8, PROSE + "And then something else happened, entirely unlike the rest of it. " + PROSE),
        (9, long), (10, long + " end"), (11, "de " * 3_000), (12, "ab" * 700), (13, "ÄÖÜ straße İstanbul 東京 \x1c   x y ẞ é"),
        (14, "MiXeD CaSe TeXt <|endoftext|> <s> ▁▁ <0x41> \U0001f600"), (-20, "negative id"), (6, "another text under the same id"),
    ]
    return [(i, t, None if k % 3 else "en", None if t is None else len(t), 7, *["x"] * 9) for k, (i, t) in enumerate(texts)]


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def table(folder, name, columns):
    return duckdb.connect().execute(f"select {columns} from '{folder}/{name}.parquet'").fetchall()


def components(n, pairs):
    """The smallest member of everything joined to each of 0 .. n - 1."""
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in pairs:
        i, j = sorted((find(i), find(j)))
        root[j] = i
    return [find(i) for i in range(n)]
