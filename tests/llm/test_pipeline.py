import os

import pytest

import corpus_pipeline
from proofline.llm import queries
from proofline.llm.common import stored

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


def test_stages_are_those_agreed():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality rules", "near duplicates", "benchmark decontamination", "secret scans", "sentencepiece"
    ]


def test_each_stage_against_plain_python(spark):
    """The kept documents of every stage, from the operators' own reports and from plain search."""
    import sentencepiece

    from proofline.llm import quality, secrets, simhash

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    verdict = {r.doc_id for r in quality.report(docs).filter("kept").collect()}
    one = stored(corpus_pipeline.STAGES[0][1](spark, docs, FOLDER), "t")
    assert one.columns == columns and {r.doc_id for r in one.collect()} == verdict

    prints = {r.doc_id: simhash.fingerprint(r.text.encode()) for r in one.collect()}
    first = {}
    for i in sorted(prints):  # the smallest id reachable
        first.setdefault(i, i)
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 3 and first[b] < first[a]:
                    first[a], changed = first[b], True
    two = stored(corpus_pipeline.STAGES[1][1](spark, one, FOLDER), "t")
    assert two.columns == columns and {r.doc_id for r in two.collect()} == {i for i in first if first[i] == i}

    passages = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    three = stored(corpus_pipeline.STAGES[2][1](spark, two, FOLDER), "t")
    texts = {r.doc_id: r.text for r in two.collect()}
    assert three.columns == columns
    assert {r.doc_id for r in three.collect()} == {i for i, t in texts.items() if not any(p in t for p in passages)}

    four = stored(corpus_pipeline.STAGES[3][1](spark, three, FOLDER), "t")
    assert four.columns == columns and four.count() == three.count()
    found = {r.doc_id: r.secrets for r in secrets.scan(three).collect()}
    for r in four.collect():
        assert ("[SECRET]" in r.text) == bool(found[r.doc_id]) and (found[r.doc_id] or r.text == texts[r.doc_id])
        assert r.n_chars == len(r.text)

    five = {r.doc_id: r.n_tokens for r in corpus_pipeline.STAGES[4][1](spark, four, FOLDER).collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_file("piece_bpe_32k.model"))
    assert five == {r.doc_id: len(library.encode(r.text)) for r in four.collect()}


def test_all_queries_are_registered():
    numbers = {int(name[2:].split("_")[0]) for name in queries.registered()}
    assert numbers == set(range(1, 14)) and set(queries.oracles()) <= set(queries.registered())


def test_repeated_and_missing_values_pass_through(spark, documents):
    text = "some plain words that make a text which is long enough to be kept by the rules of this small test here"
    df = documents((1, text), (1, text), (None, text + " and more of them at the end"), (2, None), (3, ""))
    for _, stage in corpus_pipeline.STAGES:
        df = stored(stage(spark, df, FOLDER), "t")
    assert {r.doc_id for r in df.collect()} <= {1, None}


def test_blotted_text_is_worked_out_once(spark, documents):
    """The text and its length come from one expression, so the plan does not hold it twice."""
    df = documents((1, "token=abcdefghijklmnop and more"), (2, "nothing here"), (3, None))
    out = corpus_pipeline.secret_scans(spark, df, FOLDER)
    assert {r.doc_id: (r.text, r.n_chars) for r in out.collect()} == {
        1: ("[SECRET] and more", 17), 2: ("nothing here", 12), 3: (None, 0)
    }
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[SECRET]") <= 1 + plan.count("Union") * 1
