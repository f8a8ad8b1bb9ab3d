"""The pipeline's result against its stages written out in plain Python."""

import hashlib
import os
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_counts import brute_targets
from test_dedup import brute_components, kept_lines
from test_search_toxicity import plain_score

import corpus_pipeline
from quern.llm import toxicity
from quern.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


def brute_times(rows):
    """How often the mix takes each (doc_id, text, source): whole copies, and once more below the hash that meets the budget."""
    sizes, groups = Counter(), defaultdict(list)
    for i, t, s in rows:
        n = len((t or "").encode().split())
        sizes[s] += n
        h = int(hashlib.md5(f"{i}|{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest()[:12], 16)
        groups[s].append((h, n, i))
    targets, times = brute_targets(sizes), Counter()
    for s, docs in groups.items():
        copies = int(targets[s] // sizes[s]) if sizes[s] else 0
        budget = targets[s] - copies * sizes[s]
        cells = defaultdict(int)
        for h, n, _ in docs:
            cells[h] += n
        until, run = 1 << 48, 0
        for h in sorted(cells):
            run += cells[h]
            if run > budget:
                until = h + (run - budget < budget - run + cells[h])
                break
        for h, _, i in docs:
            times[i] += copies + (budget > 0 and h < until)
    return times


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline_matches_its_stages_in_plain_python(spark):
    from tokenizers import Tokenizer

    table, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    network = toxicity.train(table, labels)
    rows = [(r.doc_id, r.text, r.source) for r in table.collect()]
    source = {i: s for i, _, s in rows}
    clean = [(i, t) for i, t, _ in rows if plain_score(network, t) < 0.5]
    assert len(clean) < len(rows)
    lines = [(i, "\n".join(kept)) for i, kept in kept_lines(clean)]
    component, _ = brute_components(lines, corpus_pipeline.NEAR_PERCENT)
    alone = [(i, t, source[i]) for i, t in lines if component[i] == i]
    times = brute_times(alone)
    lib = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    tokens = {i: len(lib.encode(t, add_special_tokens=False).ids) + 1 for i, t, _ in alone}
    got, sequences = defaultdict(int), defaultdict(int)
    for p in corpus_pipeline.run(spark, SF).collect():
        assert p.doc_tokens == tokens[p.doc_id]
        got[p.doc_id] += p.length
        sequences[p.sequence_id] += p.length
    assert got == {i: n * tokens[i] for i, n in times.items() if n}
    assert all(n & (n - 1) == 0 for n in sequences.values()) and np.mean(list(sequences.values())) > 200
