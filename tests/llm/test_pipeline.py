import random
import re

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from hirameki.llm import quality

from .test_linededup import brute as lines_gone
from .test_near import brute as classes
from .test_quality import brute as counts


def corpus():
    rnd = random.Random(8)
    stop = ["the", "of", "and", "to", "in"]
    rows, passages = [], [" ".join(f"p{k}w{i}" for i in range(30)) for k in range(2)]
    for i in range(40):
        sentences = [" ".join(rnd.choice(stop) if rnd.random() < 0.3 else f"w{rnd.randint(0, 3000)}" for _ in range(rnd.randint(8, 25))) for _ in range(rnd.randint(2, 6))]
        if i % 7 == 3:
            sentences.insert(1, "A line that comes in many documents of the corpus")
        if i % 9 == 4:
            sentences[-1] += " " + rnd.choice(passages)
        rows.append("\n".join(sentences))
    one = " ".join(rnd.choice(stop) if rnd.random() < 0.3 else f"v{rnd.randint(0, 3000)}" for _ in range(70))
    rows += [one, one + " other end", "another " + one, rows[0] + "\nand one more line at the end", rows[1], rows[2].replace("the", "teh", 1), "", "short", "### | $$$ %% && the of and to in ###" * 3, "x y " * 40, None]
    return [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(rows)]


def brute_stages(rows):
    """Documents (doc_id, text) after each stage but the last."""
    docs, out = [(r[0], r[1]) for r in rows], []
    kept = []
    for d, t in docs:
        n, chars, symbols, dup, again = counts(t)
        w = max(n, 1)
        lines = max(1, sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in (t or "").split("\n")))
        stops = sum(x.lower() in quality.STOP_WORDS for x in re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        values = {"n_words": n, "mean_word_chars": chars / w, "symbols_per_word": symbols / w, "bangs_per_word": (t or "").count("!") / w, "stop_word_ratio": stops / w, "dup_line_ratio": dup / lines}
        rules = all((lo is None or values[m] >= lo) and (hi is None or values[m] <= hi) for m, lo, hi in quality.THRESHOLDS)
        if n >= 10 and 100 * again <= 20 * n and rules:
            kept.append((d, t))
    out.append(kept)
    gone = lines_gone(kept, 20)
    kept = [(d, "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d])) for d, t in kept]
    out.append(kept)
    kept = [r for r, c in zip(kept, classes(kept, 0.8), strict=True) if r[0] == c]
    out.append(kept)
    first, left = {}, []
    docs = [(d, re.findall(r"[^\x20\x09-\x0D]+", t), t) for d, t in kept]
    for d, w, _ in docs:
        for p in range(len(w) - 19):
            first.setdefault(tuple(w[p : p + 20]), (d, p))
    for d, w, t in docs:
        cut = {q for p in range(len(w) - 19) if first[tuple(w[p : p + 20])] != (d, p) for q in range(p, p + 20)}
        left.append((d, [x for i, x in enumerate(w) if i not in cut], t if not cut else None))
    out.append(left)
    return out


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, docs, str(folder))
        out.append((result.columns, result.collect()))
        result.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return folder, out


def test_stages_against_brute_force(stages):
    _, found = stages
    want = brute_stages(corpus())
    assert len(want[0]) < len(corpus()) and sum(len(t) for _, t in want[1]) < sum(len(t) for _, t in want[0]) and len(want[2]) < len(want[1])
    for (columns, rows), expected in zip(found[:3], want[:3], strict=True):
        assert columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert sorted((r["doc_id"], r["text"]) for r in rows) == sorted(expected)
        assert all(r["n_chars"] == len(r["text"]) for r in rows)
    assert sorted((r["doc_id"], re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in found[3][1]) == sorted((d, w) for d, w, _ in want[3])
    assert all(r["text"] == t for r in found[3][1] for d, _, t in want[3] if d == r["doc_id"] and t is not None)
    assert any(t is None for _, _, t in want[3])


def test_packing_holds_what_is_left(spark, stages):
    folder, found = stages
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = {r["doc_id"]: r["text"] for r in found[3][1]}
    for rows in (found[4][1], corpus_pipeline.run(spark, str(folder)).collect()):
        ids = {}
        for r in sorted(rows, key=lambda r: r["start"]):
            ids.setdefault(r["doc_id"], []).extend(np.frombuffer(r["ids"], "<u4").tolist())
        assert ids == {d: [*library.encode(t, add_special_tokens=False).ids, 0] for d, t in texts.items()}
