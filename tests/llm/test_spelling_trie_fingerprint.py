"""Spelling variants, the prefix trie and document fingerprints against brute force, and their edge cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from matquarry.llm import fingerprint, prefixtrie, spelling

CLASHING = ("word", "n", "key", "h", "part", "vector", "head", "text_md5", "digest", "words", "own", "kept", "next_id")


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in CLASHING})


# 11


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def slow_words(docs):
    total = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                total[run] += 1
    return {w: n for w, n in total.items() if n >= 2}


def slow_variants(words, ratio=10):
    links = {w: [o for o in words if near(w, o)] for w in words}
    form = {}
    for w, others in links.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, words[w], len(links[w]), words[form[w]] if form[w] else None))
    return out


def spoilt(rng, word):
    letters, at, kind = "abcdefghéß", rng.integers(len(word)), rng.integers(3)
    c = letters[rng.integers(len(letters))]
    return [word[:at] + word[at + 1 :], word[:at] + c + word[at:], word[:at] + c + word[at + 1 :]][kind]


def test_spelling_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    base = ["".join(rng.choice(list("abcdeéÀß"), rng.integers(7, 12))) for _ in range(25)]
    docs = []
    for i in range(120):
        words = [base[rng.integers(25)] for _ in range(30)] + [spoilt(rng, base[rng.integers(25)]) for _ in range(6)]
        docs.append((i if i % 40 else None, "-".join(w.upper() if rng.random() < 0.1 else w for w in words)))
    docs += [(1, None), (2, ""), (3, "x" * 30_000 + " " + "x" * 29_999), (4, "x" * 30_000 + " " + "x" * 29_999), (5, docs[1][1]), (5, docs[1][1]), (6, "×÷ Straße")]
    got = spelling.spelling(clashing(spark.createDataFrame(docs, "doc_id long, text string")).repartition(5)).collect()
    assert len(got) == len({r["word"] for r in got})
    assert {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got} == slow_variants(slow_words(docs))


@pytest.mark.parametrize("dense", [2, 4096])
def test_hot_keys_are_split_without_loss(spark, dense):
    rng = np.random.default_rng(6)
    words = {"prefixed" + "".join(rng.choice(list("ab"), 5)) + "suffixed" for _ in range(60)} | {"".join(rng.choice(list("ab"), 7)) for _ in range(60)} | {"aaaaaaa", "aaaaaaaa", "aaaaaaaaa"}
    words = {w: int(n) for w, n in zip(sorted(words), rng.integers(2, 300, len(words)))}
    got = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long"), dense=dense).collect()
    assert {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got} == slow_variants(words)


def test_groups_longer_than_a_block(spark, monkeypatch):
    rng = np.random.default_rng(8)
    words = {"commonhead" + "".join(rng.choice(list("abcd"), 3)): 2 for _ in range(300)}
    batches = spelling.near_pairs(spark.createDataFrame(list(words.items()), "word string, n long")).collect()
    assert {(r["word"], r["other"]) for r in batches} == {(a, b) for a in words for b in words if near(a, b)} and len(batches) == len({(r["word"], r["other"]) for r in batches})


def test_spelling_of_nothing(spark):
    assert spelling.spelling(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# 12


def slow_trie(turns):
    own = defaultdict(list)
    for c, t, r, x in turns:
        if c is not None:
            r, x = r or "", x or ""
            own[c].append((t is not None, t or 0, hashlib.md5(f"{len(r)}:{r}:{x}".encode()).hexdigest(), r, x))
    own = {c: [k[3:] for k in sorted(v)] for c, v in own.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = own.get(c - int(np.fmod(c, 20)), [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    kids = Counter(p[:-1] for p in members if p)
    out = set()
    for p, m in members.items():
        inside = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in inside if q)
        ends = hashlib.sha256(",".join(str(c) for c in sorted(m) if len(whole[c]) == len(p)).encode()).hexdigest()
        out.add((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], sum(not kids[q] for q in inside), saved, ends))
    return out


def found_trie(df):
    rows = prefixtrie.trie(df).collect()
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    assert len(rows) == len(set(map(tuple, rows)))
    return {tuple(r[c] for c in names) for r in rows}


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    texts = ["hello there", "yes", "no \t way", "", None, "a b c d"]
    turns = []
    for c in [*range(-25, 60), *range(2000, 2060)]:
        for t in range(rng.integers(1, 9)):
            if rng.random() < 0.95:
                turns.append((c, t if rng.random() < 0.95 else None, ["user", "assistant", None][min(2, int(rng.exponential(0.8)))], texts[min(5, int(rng.exponential(1.2)))]))
    turns += [(None, 1, "user", "lost"), (3, 1, "user", "yes"), (3, 1, "user", "yes")] + [(777, t, "user", "w" * 10 + f" {t}") for t in range(300)]
    turns += [(c, 0, "user", "copied") for c in range(3001, 3400)]
    df = clashing(spark.createDataFrame(turns, SCHEMA)).repartition(4)
    assert found_trie(df) == slow_trie(turns)


def test_small_tries(spark):
    assert prefixtrie.trie(spark.createDataFrame([], SCHEMA)).count() == 0
    for turns in ([(21, 0, "u", "a")], [(5, 0, "u", "one two"), (6, 0, "u", "one two"), (45, 0, "u", "one"), (45, 1, "u", "x")]):
        assert found_trie(spark.createDataFrame(turns, SCHEMA)) == slow_trie(turns)


def test_members_are_hashed_over_several_packs(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "PACK", 7)
    rows = [(b"k%d" % (i % 3), i) for i in range(1000)]
    got = {bytes(r["key"]): r["ends"] for r in prefixtrie.member_digests(spark.createDataFrame(rows, "k binary, m long"), "k", "m").collect()}
    assert got == {k: hashlib.sha256(",".join(str(m) for x, m in rows if x == k).encode()).hexdigest() for k in {x for x, _ in rows}}


# 13


def slow_vector(text):
    lanes = [0] * 8
    marks = []
    for piece in (text or "").split("\n"):
        digest = hashlib.sha256(piece.encode()).hexdigest()
        lanes = [(v + int(digest[8 * i : 8 * i + 8], 16)) % (1 << 32) for i, v in enumerate(lanes)]
        marks += [int(hashlib.md5(p.encode()).hexdigest()[:15], 16) for p in re.split(r"(?<=[aeo.,;:!?])[\x20\x09\x0B-\x0D]", piece) if p]
    return [*lanes, len(marks), *(sum(m >> b & 1 for m in marks) for b in range(60))]


def slow_edits(docs):
    places = sorted({(i, t or "") for i, t in docs}, key=lambda p: (p[0] is None, -(p[0] or 0), hashlib.md5(p[1].encode()).hexdigest()))
    out = {}
    for at, (i, text) in enumerate(places):
        after, m = places[(at + 1) % len(places)][1], len(text) // 3
        out[i, text] = (text[: len(text) - m] + after[:m], after)
    return out


def test_fingerprints_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    words = ["une", "café", "house", "Straße", "x,", "日本語", "🙂", "end."]
    docs = []
    for i in range(60):
        docs.append((i, "".join(str(rng.choice(words)) + str(rng.choice([" ", "  ", "\n", "\t", "\n\n", "\r\n"])) for _ in range(rng.integers(0, 40)))))
    docs += [(None, "null id one"), (None, "null id two"), (7, "another text, the same id"), (8, None), (8, ""), (9, docs[9][1]), (9, docs[9][1]), (100, "word " * 3000), (101, "ab"), (102, "\n\n\n")]
    got = fingerprint.edited_fingerprints(clashing(spark.createDataFrame(docs, "doc_id long, text string")).repartition(5)).collect()
    edits = slow_edits(docs)
    assert sorted((repr(r["doc_id"]), r["text"]) for r in got) == sorted((repr(i), t or "") for i, t in docs)
    for r in got:
        edited, after = edits[r["doc_id"], r["text"]]
        assert r["edited"] == edited and r["n_chars"] == len(r["text"])
        assert r["vector"] == slow_vector(r["text"]) and r["edited_vector"] == slow_vector(edited) and r["next_vector"] == slow_vector(after)


def test_fingerprints_are_homomorphic_and_ordered_by_nothing(spark):
    a, b = "first paragraph.\nsecond one, longer", "third\nfirst paragraph."
    rows = [(1, a), (2, b), (3, a + "\n" + b), (4, "third\nsecond one, longer\nfirst paragraph.\nfirst paragraph."), (5, "something else entirely")]
    made = fingerprint.with_vector(spark.createDataFrame(rows, "i int, t string"), "t", "v")
    v = {r["i"]: r["v"] for r in made.collect()}
    assert v[3] == v[4] != v[1]
    one = spark.createDataFrame([(v[1], v[2], v[3], v[5])], "a array<long>, b array<long>, c array<long>, d array<long>")
    found = one.select(
        fingerprint.plus(F.col("a"), F.col("b")).alias("sum"), fingerprint.minus(F.col("c"), F.col("b")).alias("rest"), fingerprint.likeness(F.col("c"), F.col("c")).alias("same"),
        fingerprint.likeness(F.col("a"), F.col("c")).alias("near"), fingerprint.likeness(F.col("a"), F.col("d")).alias("far"), fingerprint.printed(F.col("a")).alias("printed"),
    ).first()
    assert found["sum"] == v[3] and found["rest"] == v[1] and found["same"] == 1.0 and found["near"] > 0.5 > found["far"] and len(found["printed"]) == 69 * 8


def test_fingerprints_of_few_documents(spark):
    assert fingerprint.edited_fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    alone = fingerprint.edited_fingerprints(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).collect()
    assert [(r["edited"], r["next_id"]) for r in alone] == [("abcdab", 1)]
