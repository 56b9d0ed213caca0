"""Operators that SQL can express, held against DuckDB; edge cases of every operator."""

import pytest

from tessera.llm import chat_examples, hmm, line_rules, lsa, mixture, pii, quality, queries, simhash, suffixes, toxicity
from tests.helpers import same

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row_key string, words string, p string, _key string"
LONG = "word " * 30000


def awkward(spark):
    """Nulls in every column, empty and long texts, repeated rows, ties, and extra columns whose names operators use themselves."""
    rows = [
        (1, "The first text. It ends here.", "en", "a", 29, "x", "y", "z", "k"),
        (1, "The first text. It ends here.", "en", "a", 29, "x", "y", "z", "k"),
        (2, None, "en", "a", None, None, None, None, None),
        (3, "", None, None, 0, "x", "y", "z", "k"),
        (None, "no id, but text.", "de", "b", 16, "x", "y", "z", "k"),
        (None, None, None, None, None, None, None, None, None),
        (4, LONG, "en", "a", len(LONG), "x", "y", "z", "k"),
        (5, " \n\n ", "en", "a", 4, "x", "y", "z", "k"),
        (6, "You are an idiot. Mail a.b@c.org now!", "en", "c", 38, "x", "y", "z", "k"),
    ]
    return spark.createDataFrame(rows, DOCS)


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 0), (6, 0, 1), (None, 1, 1), (2, None, None), (1, 1, 0)], "doc_id long, quality int, toxic int")


def benchmark(spark):
    return spark.createDataFrame([(1, "a b c"), (2, None), (None, "x"), (3, "one two three four five six seven eight nine ten")], "item_id long, text string")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, duck, sf_dir, name):
    assert same(queries.queries()[name](spark, sf_dir), duck, queries.oracle_sql()[name])


APPLY = {
    "hmm": lambda s, d: hmm.language_model_scores(d),
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "pii": lambda s, d: pii.personal_data(d),
    "redacted": lambda s, d: pii.redacted(d),
    "lines": lambda s, d: line_rules.clean_lines(d),
    "mixture": lambda s, d: mixture.mix(d),
    "sample": lambda s, d: mixture.sample(d),
    "lsa": lambda s, d: lsa.contamination(d, benchmark(s)),
    "decontaminated": lambda s, d: lsa.drop_contaminated(d, benchmark(s)),
    "suffixes": lambda s, d: suffixes.repeated_passages(d),
    "quality": lambda s, d: quality.quality(d, labels(s)),
    "toxicity": lambda s, d: toxicity.toxicity(d, labels(s)),
    "drop_toxic": lambda s, d: toxicity.drop_toxic(d, labels(s)),
}
ONE_EACH = {"hmm", "simhash", "pii", "redacted", "lines", "mixture", "quality", "toxicity"}


@pytest.mark.parametrize("name", sorted(APPLY))
def test_awkward_rows(spark, name):
    found = APPLY[name](spark, awkward(spark)).collect()
    if name in ONE_EACH:
        assert len(found) == 9


@pytest.mark.parametrize("name", sorted(APPLY))
def test_empty_table(spark, name):
    assert APPLY[name](spark, awkward(spark).limit(0)).collect() == []


def test_defined_results(spark):
    docs = awkward(spark)
    scores = {(r.doc_id, r.n_words): r for r in hmm.language_model_scores(docs).collect()}
    assert scores[(2, 0)].log_likelihood == 0.0 and scores[(2, 0)].perplexity is None
    groups = simhash.near_duplicates(docs).collect()
    assert sorted(r.keep for r in groups if r.doc_id == 1) == [False, True]
    assert all(r.keep for r in groups if r.doc_id in (2, 3, 4, 5, 6))
    cleaned = {r.doc_id: r for r in line_rules.clean_lines(docs).collect()}
    assert cleaned[3].kept_share == 1.0 and cleaned[3].keep and cleaned[5].n_lines == 0
    toxic = {r.doc_id: r.toxic for r in toxicity.toxicity(docs).collect()}
    assert toxic[6] and not toxic[2] and not toxic[1]
    redacted = {r.doc_id: r for r in pii.redacted(docs).collect()}
    assert redacted[6].text == "You are an idiot. Mail [EMAIL] now!" and redacted[6].n_chars == len(redacted[6].text) and redacted[2].text is None
    assert redacted[6].words == "y"


def test_conversations(spark):
    rows = [(1, 0, "user", "hi <|end|>", "x"), (1, 1, "assistant", "yo", "x"), (1, 1, "assistant", "yo", "x"), (1, 2, "user", None, None), (1, 3, "Assistant", None, "x"), (None, 0, "user", "a", "x"), (2, None, "assistant", "b", "x"), (3, 0, None, "c", "x"), (4, 0, "assistant", "first", "x")]
    out = {(r.conv_id, r.turn): r for r in chat_examples.prefix_target_examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, prompt string")).collect()}
    assert sorted(out) == [(1, 1), (1, 3), (4, 0)]
    a = out[(1, 1)]
    assert a.prompt == "<|user|>\nhi < |end|>\n<|end|>\n<|assistant|>\n".replace("hi < |end|>\n", "hi < |end|>")
    assert a.text[a.train_start : a.train_end] == "yo<|end|>\n" and out[(1, 3)].n_context == 3 and out[(4, 0)].prompt == "<|assistant|>\n"
    empty = chat_examples.prefix_target_examples(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert empty.collect() == []
