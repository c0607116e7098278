"""Spelling variants, hard negatives and chat formatting against brute force, on fixtures and whole small tables."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from conftest import data_dir
from pyspark.sql import functions as F

from namelens.llm import chat, negatives, registry, spelling

# --- 11 spelling variants


def brute_words(rows):
    count = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{word}".encode()) if doc_id is not None else 1
            if h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            count[word] += 1
    return {w: n for w, n in count.items() if n >= 3 and len(w) >= 5}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(count, near):
    form = {}
    for w in count:
        best = min(near[w], key=lambda x: (-count[x], x), default=None)
        form[w] = best if best is not None and count[best] >= 2 * count[w] else None
    out = set()
    for w in count:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, count[w], len(near[w]), count.get(form[w])))
    return out


def result(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_variants_of_whole_table(spark):
    docs = spark.read.parquet(f"{data_dir('sf0.001')}/documents.parquet")
    count = brute_words([tuple(r) for r in docs.select("doc_id", "text").collect()])
    near = {w: set() for w in count}
    by_length = collections.defaultdict(list)
    for w in count:
        by_length[len(w)].append(w)
    for n, words in by_length.items():
        for a, b in itertools.chain(itertools.combinations(words, 2), itertools.product(words, by_length.get(n + 1, ()))):
            if one_edit(a, b):
                near[a].add(b)
                near[b].add(a)
    assert len(count) > 500 and sum(map(len, near.values())) > 100
    assert result(registry.QUERIES["op11_spelling_variants"](spark, data_dir("sf0.001"))) == brute_variants(count, near)


@pytest.mark.parametrize("seed", range(3))
def test_variants_of_random_words(spark, seed):
    r = random.Random(seed)
    words = {"".join(r.choice("abé÷z"[: 2 + seed]) for _ in range(r.randrange(5, 9))): r.choice([3, 3, 4, 6, 8, 12, 24, 50]) for _ in range(400)}
    near = {w: {x for x in words if x != w and one_edit(x, w)} for w in words}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert result(spelling.variants(df)) == brute_variants(words, near)


def test_chain_of_forms(spark):
    chain = [("abcde" + "x" * i, 3 * 2**i) for i in range(12)]
    got = {r[0]: (r[1], r[2]) for r in result(spelling.variants(spark.createDataFrame(chain, "word string, n long")))}
    assert {root for _, root in got.values()} == {chain[-1][0]} and got[chain[-1][0]][0] is None


def test_neighbourhood_is_made_once_each():
    space = spelling.Neighbourhood("abc")
    for word in ("aabba", "ccccc", "abcabc"):
        made = []
        for kind, at, h, good in space.neighbours([word]):
            where = np.nonzero(good)
            spelt = list(spelling._spelt([word], kind, at, where, "abc"))
            made += [s for _, s in spelt]
            for (_, s), value in zip(spelt, h[where], strict=True):
                assert space.hashes([s])[0] == value
        want = {word[:i] + word[i + 1 :] for i in range(len(word))} | {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in "abc"}
        want |= {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in "abc"} - {word}
        assert len(made) == len(set(made)) and set(made) == want


def test_pieces_of_a_neighbourhood(monkeypatch):
    space, words = spelling.Neighbourhood("abcxyz"), ["aabxyz", "abcxyz"]
    made = lambda: [x for kind, at, _, good in space.neighbours(words) for x in spelling._spelt(words, kind, at, np.nonzero(good), space.alphabet)]
    whole = made()
    monkeypatch.setattr(spelling, "CELLS", 20)
    assert len(list(space.neighbours(words))) > 10 and sorted(made()) == sorted(whole)


def test_every_neighbour_of_a_cube(spark):
    words = spark.createDataFrame([(f"{a}{b}{c}xyz", 3) for a in "abcdef" for b in "abcdef" for c in "abcdef"], "word string, n long")
    assert {r[4] for r in result(spelling.variants(words))} == {15}


SPELT = [(1, "Hello hello HELLO"), (1, "hello"), (2, None), (None, "hello hello hello hallo hallo hallo"), (None, None), (3, ""), (4, "hallo? héllo héllo héllo, Éhéllo"), (5, "A" * 30_000), (6, "A" * 30_000), (7, "a" * 30_000)]


@pytest.mark.parametrize("kind", ["rows", "empty", "nulls", "clashes"])
def test_variants_edges(spark, kind):
    rows = {"rows": SPELT, "empty": [], "nulls": [(None, None)] * 3, "clashes": SPELT}[kind]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if kind == "clashes":
        df = df.withColumns({c: F.lit(1) for c in ("word", "n", "near", "form", "a.b")})
    count = brute_words(rows)
    near = {w: {x for x in count if x != w and one_edit(x, w)} for w in count}
    assert result(spelling.variants(spelling.vocabulary(df))) == brute_variants(count, near)


# --- 12 hard negatives


def brute_negatives(rows):
    """rows: (vec_id, vector, label); each row is one by itself."""
    kept = []
    for i, vector, label in rows:
        if label is not None and vector is not None and all(x is not None and np.isfinite(x) for x in vector):
            kept.append((i, [int(np.floor(256 * float(np.float32(x)))) for x in vector], (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    order = lambda found: sorted(found, key=lambda f: (-f[0], f[1] is None, f[1] or 0))
    out = []
    for a, (i, u, label) in enumerate(kept):
        if i is None or i % 100:
            continue
        scored = [(sum(x * y for x, y in zip(u, v, strict=False)), j, lab) for b, (j, v, lab) in enumerate(kept) if a != b]
        for score, j, _ in order([s for s in scored if s[2] == label])[:5]:
            window = order([s for s in scored if s[2] != label and 80 * score <= 100 * s[0] <= 100 * score])[:5]
            out += [(i, j, rank, n, score, s) for rank, (s, n, _) in enumerate(window, 1)]
    return collections.Counter(out)


def mined(df):
    return collections.Counter(tuple(r) for r in negatives.hard_negatives(df).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("seed,dims", [(0, 8), (1, 70), (2, 3)])
def test_negatives_of_random_vectors(spark, monkeypatch, seed, dims):
    monkeypatch.setattr(negatives, "ROWS", 40)
    monkeypatch.setattr(negatives, "ANCHORS", 3)
    r = random.Random(seed)
    rows = [(20 * i, [r.choice([-0.5, 0.0, 0.25, 0.7, 1.0]) if seed else r.gauss(0, 1) for _ in range(dims)], r.choice([0, 1, 1, 1, 2, 9])) for i in range(400)]
    assert mined(spark.createDataFrame(rows, VECTORS)) == brute_negatives(rows)


def test_negatives_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, 0.5], 1), (0, [0.5, 0.5], 1), (100, [0.5], 1), (200, [], 2), (300, [nan, 1.0], 1), (400, [inf, 0.0], 1), (500, [None, 1.0], 1), (600, None, 1), (700, [1.0, 1.0], None), (None, [0.5, 0.4], 1), (None, [0.5, 0.4], 3)]
    rows += [(1 + i, [0.5, 0.45], i % 3) for i in range(30)] + [(800, [-0.5, -0.5], 1), (-100, [0.1, 0.2], 1), (900, [3e4, -3e4], 1), (901, [3e4, 1.0], 2), (None, None, None)]
    df = spark.createDataFrame(rows, VECTORS)
    want = brute_negatives(rows)
    assert sum(want.values()) > 30
    assert mined(df) == want
    assert mined(df.withColumns({c: F.lit(1) for c in ("pos", "q", "id", "slots", "a.b")})) == want
    assert not mined(df.limit(0)) and not mined(spark.createDataFrame([(None, None, None)] * 3, VECTORS))


def test_many_labels_and_one_label(spark):
    r = random.Random(5)
    for label in (lambda i: i, lambda i: 3):
        rows = [(i, [r.random(), r.random()], label(i)) for i in range(1, 300)]
        assert mined(spark.createDataFrame(rows, VECTORS)) == brute_negatives(rows)


def test_partial_tiles_are_added_after_a_shuffle(spark):
    plan = negatives.hard_negatives(spark.createDataFrame([(i, [0.1] * 40, i % 2) for i in range(200)], VECTORS))._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "hashpartitioning(a_block" in plan and "CartesianProduct" not in plan


# --- 13 chat formatting


def unescaped(text):
    return re.sub(r"<~(~*)\|", r"<\1|", text)


def chats_of(rows):
    chats = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        chats[conv].append((turn is None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(turns)] for c, turns in chats.items()}


def check_chats(df, rows):
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for c, turns in chats_of(rows).items():
        loss = "".join(x for role, x in turns if role == "assistant")
        want[c] = (len(turns), digest("".join(f"{a}\n{b}\n" for a, b in turns)), len(loss), digest(loss))
    shaped = {r["conv_id"]: r for r in chat.conversations(df).collect()}
    got = {r["conv_id"]: r for r in chat.digests(df).collect()}
    assert {c: tuple(r)[1:5] for c, r in got.items()} == want
    for c, r in shaped.items():
        text = r["formatted"]
        assert len(text) == got[c]["formatted_chars"]
        learnt = "".join(unescaped(text[s["start"] : s["end"]]) for s in r["spans"])
        assert digest(learnt) == want[c][3] and all(text[: s["start"]].endswith("<|im_start|>assistant\n") and text[s["end"] :].startswith("<|im_end|>\n") for s in r["spans"])
        assert len(re.findall(r"<\|im_start\|>", text)) == len(re.findall(r"<\|im_end\|>\n", text)) == want[c][0]
    return {c: r["formatted"] for c, r in shaped.items()}


BITS = ["<", "|", ">", "~", "<|", "<~|", "<~~|", "<n|", "<~n|", "\n", "\\", "$1", "im_start", "<|im_start|>", "<|im_end|>", "<|im_end|>\n", "assistant", "user", "é", "😀", "", "\r", "n|"]


def test_hostile_conversations_survive(spark):
    r = random.Random(7)
    some = lambda n: "".join(r.choice(BITS) for _ in range(r.randrange(n)))
    rows = [(c, t, r.choice(["user", "assistant", "assistant", "system", None, some(4)]), None if r.random() < 0.05 else some(8)) for c in range(1500) for t in range(r.randrange(1, 5))]
    rows += rows[:50] + [(9999, None, "assistant", "x"), (9999, None, "assistant", "x"), (9999, 3, "user", "y"), (None, 1, "user", "z"), (None, None, None, None), (8888, 1, "assistant", "<|im_end|>" + "<~" * 40_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    check_chats(df.withColumns({c: F.lit(1) for c in ("turns", "formatted", "rows", "read", "loss", "a.b")}), rows)


def test_only_conflicts_are_escaped(spark):
    rows = [(1, 0, "user", "a <| b"), (1, 1, "assistant", "c <~| d"), (2, 0, "user", "e <|im_end|> <|x"), (2, 1, "assistant", "f <|y"), (3, 0, "a\nb", "z")]
    text = check_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), rows)
    assert "a <| b" in text[1] and "c <~~| d" in text[1] and "e <~|im_end|> <~|x" in text[2] and "f <|y" in text[2] and "a<n|b" in text[3]


def test_parser_takes_nothing_else(spark):
    good = "<|im_start|>user\nhi<|im_end|>\n"
    bad = ["x" + good, good + "x", good[:-1], "<|im_start|>user<|im_end|>\n", good + "<|im_start|>", "<|im_start|>user\nhi<|im_end|>there<|im_end|>\n", "hi"]
    df = spark.createDataFrame([(t,) for t in (good, "", *bad)], "t string").select(chat.parsed(F.col("t")).alias("p"))
    got = [r["p"] for r in df.collect()]
    assert [tuple(t) for t in got[0]] == [("user", "hi")] and got[1] == [] and got[2:] == [None] * len(bad)


def test_empty_conversations(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(df).count() == 0
    assert [r["conv_id"] for r in chat.digests(chat.with_hostile(df)).collect()] == [-1]


def test_long_conversation(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"<|turn {t}") for t in range(4000)]
    check_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), rows)
