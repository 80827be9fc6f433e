import odd
from tokenizers import Tokenizer, models, pre_tokenizers

from gradewell.llm.queries import UNIGRAM_MODEL, op7_token_counts, tokenizer_path
from gradewell.llm.token_counts import count_tokens, load_vocabulary

SMALL = "/root/testdata/sf0.001"


def counts(rows, vocabulary):
    tokenizer = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always")
    return sorted((i is None, i or 0, len(t or ""), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)


def result(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_chars"], r["n_pieces"]) for r in df.collect())


def test_whole_table(spark):
    vocabulary = load_vocabulary(tokenizer_path(UNIGRAM_MODEL))
    assert result(op7_token_counts(spark, SMALL)) == counts(odd.table(SMALL, "documents", "doc_id, text"), vocabulary)


def test_odd_rows(spark):
    vocabulary = load_vocabulary(tokenizer_path(UNIGRAM_MODEL))
    assert result(count_tokens(odd.documents(spark), vocabulary)) == counts([r[:2] for r in odd.rows()], vocabulary)
    assert count_tokens(odd.nothing(spark), vocabulary).count() == 0


def test_ties_take_the_earliest_start(spark):
    """'▁aaa': 'aa' + 'a' and 'a' + 'aa' score the same, and so do all three ways with unequal numbers of pieces."""
    byte_pieces = [(f"<0x{b:02X}>", -50.0) for b in range(256)]
    vocabulary = [("<unk>", -60.0), ("▁", -1.0), ("a", -2.0), ("aa", -4.0), ("aaa", -6.0), ("ab", -3.0), ("b", -1.0), *byte_pieces]
    rows = [(1, "aaa"), (2, "aaaa aab"), (3, "abab"), (4, "ca"), (5, " a  b ")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert result(count_tokens(df, vocabulary)) == counts(rows, vocabulary)
