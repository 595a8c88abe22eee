"""The pipeline against a brute-force version in plain Python, on the smallest documents."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pytest

import corpus_pipeline
from quivera.llm import pieces
from tests.llm.test_operators import WORD, _dropped, _fences, _measures, _similar_classes, _targets, _wide

SF = "/root/testdata/sf0.001"


def _kept_by_quality(rows):
    outside = _fences(rows)
    kept = []
    for r in rows:
        n, _, _, _, repeat, _ = _measures(r["text"])
        if n >= 10 and 100 * repeat <= 20 * n and not outside(r["text"], r["lang"], r["source"]):
            kept.append(r)
    return kept


def _without_lines(rows):
    gone = _dropped([(r["doc_id"], r["text"]) for r in rows])
    out = []
    for r in rows:
        text = "\n".join(x for k, x in enumerate(r["text"].split("\n")) if (r["doc_id"], k) not in gone)
        out.append({**r, "text": text, "n_chars": len(text)})
    return out


def _mixed(rows):
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += len(WORD.findall(r["text"]))
    target, out = _targets(sizes), []
    for source in sizes:
        own = sorted((int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:15], 16), r["doc_id"]) for r in rows if r["source"] == source)
        by_id = {r["doc_id"]: r for r in rows}
        whole = int(target[source] // sizes[source]) if sizes[source] else 0
        left, below = target[source] - whole * sizes[source], 0
        for _, i in own:
            z = len(WORD.findall(by_id[i]["text"]))
            times = min(2, whole + (2 * below + z <= 2 * left)) if sizes[source] else 0
            out += [i] * times
            below += z
    return Counter(out)


@pytest.fixture(scope="module")
def stages(spark):
    from quivera.llm.common import write_table

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(write_table(stage(spark, seen[-1], SF), "t"))
    return [[r.asDict() for r in s.collect()] for s in seen]


def test_stages(stages):
    by_id = lambda rows: {r["doc_id"]: {k: r[k] for k in corpus_pipeline.COLUMNS} for r in rows}
    docs, good, lines, unique, mixed, encoded = stages
    assert by_id(good) == by_id(_kept_by_quality(docs)) and 0 < len(good) < len(docs)
    assert by_id(lines) == by_id(_without_lines(good))
    classes = _similar_classes({r["doc_id"]: _wide(r["text"]) for r in lines})
    assert by_id(unique) == {i: r for i, r in by_id(lines).items() if classes[i] == i} and len(unique) < len(lines)
    assert Counter(r["doc_id"] for r in mixed) == _mixed(unique)
    assert Counter(r["doc_id"] for r in encoded) == Counter(r["doc_id"] for r in mixed) and all(r["round_trip"] for r in encoded)
    t = pieces.Transducer(pieces.load_model())
    assert all(r["token_ids"] == t.encode(r["text"]) for r in encoded[:40])


def test_run_is_its_stages(spark, stages):
    got = corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens").collect()
    assert Counter(tuple(r) for r in got) == Counter((r["doc_id"], r["n_tokens"]) for r in stages[-1])


def test_stage_contract():
    assert [re.sub(r"\W", "", n) for n, _ in corpus_pipeline.STAGES] == ["qualityrules", "linededup", "SimHashneardedup", "mixingsourcestotargetweights", "SentencePieceencodinganddecoding"]
