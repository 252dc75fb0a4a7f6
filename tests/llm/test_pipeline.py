"""The pipeline on a small corpus, stage by stage on the stage's own input, against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter
from pathlib import Path

import pytest

import corpus_pipeline
from larkbase.llm import queries
from larkbase.llm.shared import shared_dir

from .test_small import DOCS, sentence


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    rng = random.Random(0)
    texts = []
    for i in range(80):
        texts.append("\n".join(sentence(1000 + 10 * i + k, rng.randrange(8, 40)) for k in range(8)))
    for i in range(0, 20, 2):  # near copies: three words changed
        words = texts[i].split(" ")
        for p in rng.sample(range(len(words)), 3):
            words[p] = re.sub(r"^[^\n]+", "changed", words[p])
        texts.append(" ".join(words))
    texts += [texts[3], "too short", None, "", "spam " * 300, "\n".join(["the same line again and again"] * 60)]
    for i in range(30, 40):
        texts[i] += "\nThis one line stands in ten documents of the corpus."
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    found = [spark.read.parquet(f"{folder}/documents.parquet")]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, found[-1], str(folder)).write.parquet(f"{folder}/stage{i}")
        found.append(spark.read.parquet(f"{folder}/stage{i}"))
    return str(folder), found


def by_id(frame):
    return {r.doc_id: r for r in frame.collect()}


def test_columns_and_names(stages):
    _, found = stages
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near-dedup", "mixing", "packing"]
    assert all(f.columns == found[0].columns for f in found[:-1])
    assert {"pipeline"} | set(queries.QUERIES) >= set(queries.ORACLES)


def test_quality_keeps_what_brute_force_keeps(stages):
    def keeps(text):
        words = (text or "").split()
        n = len(words)

        def covered(k):
            seen = Counter(tuple(words[i : i + k]) for i in range(n - k + 1))
            return len({j for i in range(n - k + 1) if seen[tuple(words[i : i + k])] > 1 for j in range(i, i + k)})

        if n < 50 or 2 * covered(3) > n:
            return False
        return covered(10) == 0 or (100 * covered(10) <= 30 * n and not covered(n // 5 + 1))

    _, found = stages
    before, after = by_id(found[0]), by_id(found[1])
    assert set(after) == {i for i, r in before.items() if keeps(r.text)}
    assert all(after[i] == before[i] for i in after)


def test_lines_stay_once(stages):
    _, found = stages
    before, after = by_id(found[1]), by_id(found[2])
    assert set(before) == set(after)
    normal = lambda x: " ".join(re.findall(r"[^\W_]+", x.lower()))
    lines = Counter(normal(x) for r in after.values() for x in r.text.split("\n") if len(normal(x).split()) >= 5)
    assert lines and max(lines.values()) == 1
    kept = {normal(x) for r in after.values() for x in r.text.split("\n")}
    first_seen = {normal(x) for i in sorted(before) if i < 80 for x in before[i].text.split("\n")}
    assert first_seen <= kept | {""}
    assert all(r.n_chars == len(r.text) for r in after.values())
    assert sum("stands in ten documents" in r.text for r in after.values()) == 1


def test_near_copies_go_and_others_stay(spark, stages):
    _, found = stages
    kept = Counter(r.doc_id for r in found[3].collect())
    # Whole texts as they were before their lines were cut: near copies lose all but one, others none.
    whole = Counter(r.doc_id for r in corpus_pipeline.dedup_near(spark, found[1], "").collect())
    assert set(kept) <= set(by_id(found[2])) and max(kept.values()) == 1
    # Three of about 190 words changed is a similarity of 0.85, of which lookups find about nine in ten.
    assert all(i in whole for i in range(80)) and sum(i in whole for i in range(80, 90)) <= 3 and 90 not in whole


def test_mixture_and_batches(stages):
    _, found = stages
    before = found[3].collect()
    words: Counter = Counter()
    for r in before:
        words[r.source] += len(r.text.split())
    taken: Counter = Counter()
    copies: Counter = Counter()
    for r in found[4].collect():
        taken[r.source] += len(r.text.split())
        copies[r.doc_id] += 1
    assert max(copies.values()) <= 2 and sum(taken.values()) == pytest.approx(1.5 * sum(words.values()), rel=0.1)
    packed = Counter(r.doc_id for r in found[5].collect())
    assert packed == copies


def test_run_gives_the_last_stage(spark, stages):
    folder, found = stages
    rows = corpus_pipeline.run(spark, folder)
    assert Counter(map(tuple, rows.collect())) == Counter(map(tuple, found[-1].collect()))


def test_run_leaves_no_tables_of_former_stages(spark, tmp_path):
    rows = [(i, "\n".join(sentence(30 * i + k, 20) for k in range(4)), "en", "s", 0) for i in range(12)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    folder = Path(re.sub("^file:/+", "/", shared_dir(spark))) / "larkbase"
    before = set(folder.glob("*"))
    packed = corpus_pipeline.run(spark, str(tmp_path))
    stages = {x.name.rsplit("-", 1)[0] for x in set(folder.glob("*")) - before} & {n.replace(" ", "-") for n, _ in corpus_pipeline.STAGES}
    assert stages == {"mixing"} and packed.count() == 18
    assert spark.read.parquet(f"{tmp_path}/documents.parquet").count() == 12
