import hashlib
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest

from hirameki.llm import bytebpe, packing, tokencount, tokenfiles
from hirameki.llm.encoders import PieceEncoder

RND = random.Random(5)
ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "don't we'll ' s", "é́ ́x", "naïve ΑΣ Σ", "日本 語。", "😀 👩‍👩‍👧", "x" * 300, "aaaa aaaaaaa", "<|endoftext|> a <|endoftext|>b", "  b c d", "\x1c a \x1f b", "1234 5 67", "###$$ %%", "a\tb\r\nc\x0bd", "  lead", "trail  "]


def fuzz(n):
    alphabet = list("abcde éß\n\t '.,$1") + [" ", " ", "the ", " of", "日", "́", "<|endoftext|>", " "]
    return ["".join(RND.choices(alphabet, k=RND.randint(0, 80))) for _ in range(n)]


TEXTS = ODD + fuzz(300)


@pytest.mark.parametrize("name,rule", [("byte_bpe_50k.json", "gap"), ("word_bpe_49k.json", "drop")])
def test_pieces_encode_as_whole_texts(name, rule):
    ours = PieceEncoder(P.path(name), rule)
    latin = ["".join(RND.choices("abé .,!?;:xyzÜ  \n", k=RND.randint(0, 60))) for _ in range(300)]
    for part in (TEXTS, latin, [], [None, ""], ["İstanbul ΑΣ ǅ dž ﬁ x"]):
        found = ours.encode(pa.array(part, pa.string()))
        assert [found.flat[a : a + n].tolist() for a, n in zip(found.starts.tolist(), found.lengths.tolist(), strict=True)] == ours.direct([t or "" for t in part])


@pytest.fixture(scope="module")
def library():
    import base64

    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return path, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_replay_equals_library(spark, library):
    path, own = library
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, None])], "n_tokens int, text string")
    rows = bytebpe.decode(bytebpe.encode(df, path, P.PATTERN), path).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        text = r["text"] or ""
        ids = own.encode_ordinary(text)
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["n_tokens"] == len(ids), text
        assert bytes(r["decoded"]).decode() == text


def test_replay_where_a_merge_brings_up_a_lower_rank(tmp_path):
    import base64

    tokens = [bytes([b]) for b in range(256)] + [b"bcx", b"aa", b"ab", b"bc", b"abc", b"abcab", b"cab", b"aab", b"bcabc"]
    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)))
    ranks = bytebpe.Ranks(str(path))
    words = ["".join(RND.choices("abcx", k=RND.randint(1, 14))).encode() for _ in range(3000)]
    ids, counts = ranks.replay(words)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [lowest_first(ranks.rank, w) for w in words]
    assert [ranks.by_definition(w) for w in words] == [lowest_first(ranks.rank, w) for w in words]
    long = bytes(RND.choices(b"abcx", k=200_000))
    began = time.process_time()
    assert b"".join(tokens[i] for i in ranks.by_definition(long)) == long and time.process_time() - began < 20


def lowest_first(rank, word):
    parts = [word[i : i + 1] for i in range(len(word))]
    while True:
        pairs = [(rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in rank]
        if not pairs:
            return [rank[p] for p in parts]
        at = min(pairs)[1]
        parts[at : at + 2] = [parts[at] + parts[at + 1]]


def test_counts_equal_library(spark):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [*TEXTS, "x" * 500, " ".join(TEXTS), ("word 日本 " * 400), "a" * 300 + " " + "b" * 700, " " * 400, "😀" * 200]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "doc_id long, text string")
    for chunk, overlap in ((32_768, 256), (64, 8), (40, 30), (17, 1)):
        for r in tokencount.count_tokens(df, path, chunk=chunk, overlap=overlap, limit=20).collect():
            n = len(library.encode(r["text"] or ""))
            assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len((r["text"] or "").encode()), n > 20), (chunk, r["text"])


def test_files_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = [(i * 7 % 331, t) for i, t in enumerate(TEXTS)] + [(5000, None), (None, "last one"), (7, "again 7")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    tokenfiles.write(df, str(tmp_path / "ids"), path)
    back = tokenfiles.read(spark, str(tmp_path / "ids"))
    got = sorted(((r["start"], r["doc_id"], r["n_tokens"], r["ids"]) for r in back.collect()), key=lambda r: r[0])
    want = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    start = 0
    for (at, doc_id, n, ids), (want_id, text) in zip(got, want, strict=True):
        expected = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert (at, doc_id, n, ids) == (start, want_id, len(expected), expected)
        start += n
    plan = back.where("doc_id = 5")._jdf.queryExecution().toString()
    assert "EqualTo(doc_id,5)" in plan
    sums = {(r["start"]): r["ids_crc32"] for r in back.mapInArrow(tokenfiles.crc32, "doc_id long, start long, n_tokens long, ids_crc32 long").collect()}
    assert sums == {at: zlib.crc32(np.array(ids, "<u4").tobytes()) for at, _, _, ids in got}
    tokenfiles.write(df.limit(0), str(tmp_path / "none"), path)
    assert tokenfiles.read(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("limits", [(64, 256, None), (32, 3, None), (50, 100, 20)])
def test_packing_keeps_every_id_once_within_limits(spark, limits):
    from tokenizers import Tokenizer

    tokens, segments, loss = limits
    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = [(i, t, i % 9 if loss else None) for i, t in enumerate([*TEXTS, None, ""])]
    df = spark.createDataFrame(rows, "doc_id long, text string, prompt int").repartition(3)
    out = packing.pack(df, path, tokens=tokens, segments=segments, loss=loss, loss_from="prompt").collect()
    docs, sequences = {}, {}
    for r in out:
        docs.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    for i, t, _ in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        mine = sorted(docs[i], key=lambda r: r["start"])
        assert [x for r in mine for x in np.frombuffer(r["ids"], "<u4").tolist()] == ids
        assert [r["start"] for r in mine] == np.cumsum([0] + [r["length"] for r in mine])[:-1].tolist() and {r["doc_tokens"] for r in mine} == {len(ids)}
    used = 0
    for mine in sequences.values():
        mine.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in mine] == np.cumsum([0] + [r["length"] for r in mine])[:-1].tolist()
        assert sum(r["length"] for r in mine) <= tokens and len(mine) <= segments and sum(r["loss_tokens"] for r in mine) <= (loss or tokens)
        used += sum(r["length"] for r in mine)
    if segments > 100 and not loss:
        assert used >= 0.97 * tokens * (len(sequences) - 3)
    assert packing.pack(df.limit(0), path).count() == 0


def test_counts_of_a_text_without_places_to_splice():
    counter = tokencount.Counter(P.path("piece_bpe_32k.model"))
    text = "".join(RND.choices("abcdefgh日本語", k=1_000_000))
    began = time.process_time()
    want = len(counter.library.encode(text))
    alone, began = time.process_time() - began, time.process_time()
    assert counter([text]) == [want]
    assert time.process_time() - began < 6 * alone + 5


def heuristic(examples, limits):
    """Vector bin packing as its definition has it: (example, start, length) by sequence; examples within the limits."""
    left, out = [[i, 0, size, loss] for i, (size, loss) in enumerate(examples)], []
    while left:
        room, mine = list(limits), []
        while room[0] and room[1] and left:
            def product(x):
                return x[2] * room[0] / limits[0] ** 2 + min(x[2], x[3]) * room[2] / limits[2] ** 2 + room[1] / limits[1] ** 2

            fits = [x for x in left if x[2] <= room[0] and min(x[2], x[3]) <= room[2]]
            x = max(fits or left, key=product)  # the first of equals
            free = x[2] - x[3]  # ids of the prompt
            n = x[2] if fits else min(x[2], room[0], max(0, free) + room[2])
            if n < 1:
                break
            loss = max(0, n - max(0, free))
            mine.append((x[0], x[1], n))
            room = [room[0] - n, room[1] - 1, room[2] - loss]
            x[1], x[2], x[3] = x[1] + n, x[2] - n, x[3] - loss
            left = [y for y in left if y[2]]
        out.append(mine)
    return out


@pytest.mark.parametrize("limits", [(64, 6, 40), (100, 9, 90), (50, 50, 50)])
def test_packing_is_the_heuristic(limits):
    sizes = [(n, n - RND.randint(0, n // 2)) for n in (RND.randint(1, limits[0] // 2) for _ in range(200))]
    sizes = [(n, min(loss, limits[2])) for n, loss in sizes]
    packer = packing.Packer(*limits)
    for i, (n, loss) in enumerate(sizes):
        packer.add(i, n, n - loss)
    packer.pack()
    got = {}
    for i, start, n, loss, sequence, _ in packer.placed:
        got.setdefault(sequence, []).append((i, start, n))
    assert [got[k] for k in sorted(got)] == heuristic(sizes, limits)
    for k in got:
        assert len(got[k]) <= limits[1] and sum(n for _, _, n in got[k]) <= limits[0] and sum(p[3] for p in packer.placed if p[4] == k) <= limits[2]
    full = [max(sum(n for _, _, n in got[k]) / limits[0], len(got[k]) / limits[1], sum(p[3] for p in packer.placed if p[4] == k) / limits[2]) for k in sorted(got)[:-1]]
    assert min(full) > 0.9  # of each sequence but the last one limit is nearly used up


def test_prompt_is_what_comes_to_the_first_mark():
    flat, starts, lengths = np.array([5, 9, 1, 2, 9, 9, 3], np.uint32), np.array([0, 2, 4, 4, 7]), np.array([2, 2, 0, 3, 0])
    holds = np.zeros(10, bool)
    holds[9] = True
    assert packing.prompts(flat, starts, lengths, holds).tolist() == [2, 0, 0, 1, 0]


def test_digests():
    assert hashlib.sha256(np.array([1, 2], "<u4").tobytes()).hexdigest() == hashlib.sha256(b"\1\0\0\0\2\0\0\0").hexdigest()
