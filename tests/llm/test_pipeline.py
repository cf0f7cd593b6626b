"""The pipeline, stage by stage, against the stages' own rules in plain Python."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
import numpy as np
from gridtally.llm.common import written
from gridtally.llm.private import all_spans, masked
from gridtally.llm.packing import ORDER
from test_llm import SCHEMA, SMALL, BYTE_BPE, brute_components, check_packing, prose


def test_pipeline_against_plain_python(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "personal_data", "mix", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SMALL), name)
        assert docs.columns == columns
        rows = {r.doc_id: r for r in docs.collect()}
        if name == "language":
            assert set(rows) <= set(texts) and len(rows) >= 0.99 * len(texts)
            texts = {d: texts[d] for d in rows}
        elif name == "near_duplicates":
            texts = {d: texts[d] for d, (_, c) in brute_components(list(texts.items())).items() if c == d}
        elif name == "personal_data":
            texts = {d: masked(t, all_spans(t)[1]) for d, t in texts.items()}
            assert all(r.n_chars == len(r.text) for r in rows.values())
        assert {d: r.text for d, r in rows.items()} == texts
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    check_packing(rows, texts, Tokenizer.from_file(BYTE_BPE))
    again = corpus_pipeline.run(spark, SMALL).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, again)) == sorted(map(key, rows))


def test_pipeline_on_awkward_and_empty_tables(spark):
    from test_llm import AWKWARD, table

    for docs in (table(spark, AWKWARD), table(spark, AWKWARD).limit(0)):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = written(stage(spark, docs, SMALL), name)
            assert docs.columns == columns
        corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()


def test_sequences_follow_the_target_weights_of_the_mix(spark):
    rng = np.random.default_rng(6)
    counts = {"a": 3600, "b": 900, "c": 400}
    rows = [(i, prose(i, int(rng.integers(60, 900))), "en", s, 0, 0.5, "x") for i, s in enumerate(np.repeat(list(counts), list(counts.values())).tolist())]
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(4)
    sources = {r[0]: r[3] for r in rows}
    stages = dict(corpus_pipeline.STAGES)

    def deviation(docs):
        """The largest, over runs of 100 sequences, of the distance of a source's tokens from its target share."""
        pieces = stages["packing"](spark, docs, SMALL).collect()
        assert ORDER not in pieces[0].asDict()
        tokens = Counter()
        for r in pieces:
            tokens[r.sequence_id // 100, sources[r.doc_id]] += r.length
        total = Counter()
        for (_, source), n in tokens.items():
            total[source] += n
        mass = {s: n**0.5 for s, n in total.items()}
        target = {s: m / sum(mass.values()) for s, m in mass.items()}
        full = int(min(total[s] / target[s] for s in total) // 2048 // 100)
        assert full >= 4
        return max(
            abs(tokens[run, s] / sum(tokens[run, x] for x in total) - target[s]) for run in range(full - 1) for s in total
        )

    mixed, as_is = deviation(written(stages["mix"](spark, docs, SMALL), "mix")), deviation(written(docs, "docs"))
    print("deviation from the target shares: mixed", mixed, "without the mix", as_is)
    assert mixed < 0.1 < 0.3 < as_is
