"""The corpus pipeline over a small folder of tables, every stage against plain Python."""

from __future__ import annotations

import random
import re
import zlib

import pytest

pytest.importorskip("taskmine.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
tiktoken = pytest.importorskip("tiktoken")
public_tokenizers = pytest.importorskip("public_tokenizers")

from taskmine.llm.queries import default_ranks
from tests.llm.test_llm_operators import PII, WORD, expected_classes, lowered

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    words = ["river", "stone", "green", "window", "paper", "cloud", "seven", "garden", "market", "letter", "ópera", "straße", "mountain", "silver"]
    prose = lambda n: " ".join(rng.choice(words) + rng.choice(["", "s", "ly", "ed"]) for _ in range(n))
    texts, toxic = [], {}
    for i in range(260):
        own = prose(rng.randint(20, 90)).split()
        toxic[i] = int(rng.random() < 0.15)
        for _ in range(toxic[i] * max(1, len(own) // 10)):
            own.insert(rng.randrange(len(own)), "grumblefiend" + rng.choice(["", "s", "ish"]))
        texts.append(" ".join(own))
    clean = [i for i in range(260) if not toxic[i]]
    items = [prose(14) for _ in range(4)]
    for k, i in enumerate(clean[:12]):
        texts.append(texts[i] if k % 2 else texts[i] + " extra")  # copies and near copies
    for i in clean[20:26]:
        texts[i] += ". " + items[i % 4]
    for i in clean[30:40]:
        texts[i] += f" write to person{i}@example.org or +1 (555) 123-4567 from 10.0.0.{i}"
    texts += [None, "", "?!", "x"]
    rows = [(i, t, "en", None, len(t) if t is not None else None) for i, t in enumerate(texts)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, COLUMNS).repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, y) for i, y in toxic.items()], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, dict(enumerate(texts)), toxic, items


def test_every_stage(spark, folder):
    path, texts, toxic, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.dtypes == docs.dtypes, name
        rows = {r["doc_id"]: r["text"] for r in out.collect()}
        before = kept or texts
        if name == "toxicity":
            wrong = [i for i in texts if (i not in rows) != bool(toxic.get(i, 0)) and not (i >= 260)]
            assert len(wrong) <= 3 and set(rows) <= set(texts)
            assert {zlib.crc32(str(i).encode()) % 5 for i in wrong} <= {0, 1, 2, 3, 4}
        elif name == "near_duplicates":
            ids = sorted(before)
            classes = expected_classes([before[i] for i in ids])
            assert set(rows) == {ids[c] for c, _, _ in classes}
        elif name == "decontamination":
            windows = {tuple(w[k:k + 10]) for w in (WORD.findall(t) for t in items) for k in range(len(w) - 9)}
            own = {i: WORD.findall(lowered(t)) for i, t in before.items()}
            hit = {i for i, w in own.items() if any(tuple(w[k:k + 10]) in windows for k in range(len(w) - 9))}
            assert hit and set(rows) == set(before) - hit
        elif name == "personal_data":
            assert set(rows) == set(before)
            for i, text in before.items():
                found = any(ok(m[0]) for _, p, ok in PII for m in re.finditer(p, text or ""))
                assert (rows[i] != text) == found, i
                assert not any(ok(m[0]) for _, p, ok in PII for m in re.finditer(p, rows[i] or ""))
            assert all(r["n_chars"] == len(r["text"]) for r in out.where("text is not null").collect())
        kept, docs = rows, spark.createDataFrame(out.toArrow())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=default_ranks(), special_tokens={})
    last = {r["doc_id"]: r for r in corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()}
    assert set(last) == set(kept)
    for i, row in last.items():
        assert row["ids"] == library.encode_ordinary(kept[i] or "") and row["text"] == (kept[i] or "") and row["n_tokens"] == len(row["ids"])


def test_run_gives_the_rows_of_its_stages(spark, folder):
    path, texts, _, _ = folder
    rows = corpus_pipeline.run(spark, path).collect()
    assert {"doc_id", "n_tokens", "ids", "text"} <= set(rows[0].asDict())
    assert len({r["doc_id"] for r in rows}) == len(rows) < len(texts)
