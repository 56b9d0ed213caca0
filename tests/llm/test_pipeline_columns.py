"""The pipeline's stages against tables whose columns have the names that operators use themselves, with values checked."""

import corpus_pipeline
from tessera.llm import chat_examples, lsa, mixture, pii, quality, simhash, suffixes, toxicity

NAMES = ("_key", "_n", "_stays", "_id", "key", "row", "n", "row_key", "stays", "p", "words", "_row", "_source", "_topic", "tokens", "h", "dotted.name")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES) + ", m map<string,int>"
LONG = "plain words of a long clean text " * 8000


def rows():
    texts = ["A clean text. It ends here.", "A clean text. It ends here.", None, "", "Mail a.b@c.org now", LONG, "You are an idiot and a moron"]
    ids = [1, 1, 2, 3, 4, 5, 6]
    return [(i, t, "en", "a", None if t is None else len(t), *(f"{n}-{k}" for n in NAMES), {"x": k}) for k, (i, t) in enumerate(zip(ids, texts))]


def test_users_columns_come_back(spark, sf_dir):
    docs = spark.createDataFrame(rows(), SCHEMA)
    given = {r["_key"]: r for r in docs.collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        found = out.collect()
        for r in found:
            same = [c for c in docs.columns if not (name == "personal_data" and c in ("text", "n_chars"))]
            assert all(r[c] == given[r["_key"]][c] for c in same), name
        kept[name] = sorted(r["_key"] for r in found)
    every = sorted(given)
    assert kept["toxicity"] == [k for k in every if k != "_key-6"]
    assert kept["near_duplicates"] == [k for k in every if k != "_key-1"]
    assert kept["decontamination"] == kept["personal_data"] == every


def test_ids_without_value_and_ties(spark):
    docs = spark.createDataFrame([(None, "same words in both of these rows here", "en", "a"), (None, "same words in both of these rows here", "en", "a"), (None, "You idiot", "en", "a"), (7, "same words in both of these rows here", "en", "a")], "doc_id long, text string, lang string, source string")
    groups = [(r.doc_id, r.group_id, r.group_size, r.keep) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(groups, key=str) == sorted([(7, 7, 3, True), (None, 7, 3, False), (None, 7, 3, False), (None, None, 1, True)], key=str)
    assert sorted((r.doc_id is None, r.toxic) for r in toxicity.toxicity(docs).collect()) == [(False, False), (True, False), (True, False), (True, True)]
    assert [r.n_found for r in pii.personal_data(docs).collect()] == [0] * 4
    mixed = mixture.mix(docs).collect()
    assert len({(r.p, r.sampled) for r in mixed if r.doc_id is None and r.tokens == 8}) == 1 and {r.tokens for r in mixed} == {8, 2}
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    judged = quality.quality(docs, labels).collect()
    assert {r.p for r in judged} == {0.5} and len(judged) == 4
    items = spark.createDataFrame([(1, "words in both of these")], "item_id long, text string")
    assert sorted((r.doc_id or 0, r.item_id) for r in lsa.contamination(docs, items).collect()) == [(0, 1), (7, 1)]
    assert suffixes.repeated_passages(docs).collect() == []


def test_turns_that_tie_and_long_texts(spark):
    turns = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "z"), (1, 1, "assistant", "y"), (2, 0, "user", LONG), (2, 1, "assistant", "ok")]
    out = sorted(chat_examples.prefix_target_examples(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect(), key=lambda r: (r.conv_id, r.n_context))
    assert [(r.conv_id, r.n_context, r.target) for r in out] == [(1, 2, "y<|end|>\n"), (1, 3, "z<|end|>\n"), (2, 1, "ok<|end|>\n")]
    assert out[0].prompt.index("a<|end|>") < out[0].prompt.index("b<|end|>") and LONG in out[2].prompt
