"""N-gram join and substring deduplication against brute force, and their edge cases."""

import random
import re

import numpy as np
import pytest

from tokenloom.llm import ngram_join, shingles, substring

WORDS = [f"w{i}" for i in range(300)]


def brute_sets(text, n):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_components(docs, n, percent):
    sets = {i: brute_sets(t, n) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(rng, words):
    out = list(words)
    for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 8])):
        at, kind = rng.randrange(len(out) or 1), rng.random()
        if kind < 0.4:
            out[at] = rng.choice(WORDS)
        elif kind < 0.6:
            out.insert(at, rng.choice(WORDS))
        elif kind < 0.8 and len(out) > 4:
            del out[at]
        else:
            out = out[: max(3, len(out) - rng.randrange(6))]
    return out


def family(seed, bases=3, copies=60):
    rng, docs = random.Random(seed), []
    for _ in range(bases):
        base = [rng.choice(WORDS) for _ in range(rng.choice([25, 60, 120]))]
        pool = [base]
        for _ in range(copies):
            pool.append(edited(rng, rng.choice(pool[:12])))
        docs += [" ".join(p) for p in pool]
    docs += [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(40))) for _ in range(20)]
    docs += ["", None, "a", "A", "a b", "\t\n ", "a b c", "a b c", "x " * 5000, "nul\x00b C d"]
    rng.shuffle(docs)
    return [(i * 3, t) for i, t in enumerate(docs)]


@pytest.mark.parametrize(("seed", "size", "percent"), [(1, 3, 90), (2, 5, 80), (3, 3, 90)])
def test_groups_are_those_of_brute_force(spark, seed, size, percent):
    docs = family(seed)
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in docs], "doc_id long, text string, token int, component_id string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.groups(df, size, percent).collect()}
    assert got == brute_components(docs, size, percent)


def test_groups_of_nothing_and_of_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert ngram_join.groups(spark.createDataFrame([], schema)).count() == 0
    rows = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (None, None)], schema)
    assert sorted((r.doc_id, r.text) for r in ngram_join.keep_one(rows).collect() if r.doc_id is not None) == [(1, "a b c d e f")]  # rows with equal ids are one document
    assert ngram_join.keep_one(rows).filter("doc_id IS NULL").count() == 2


def test_ids_with_several_texts_link_with_what_any_of_them_links_with(spark):
    one, two, three = ("a b c d e f g h i j k l", "m n o p q r s t u v w x", "1 2 3 4 5 6 7 8 9 10 11 12")
    rows = [(0, one), (1, one), (1, two), (2, two), (3, three), (4, three), (3, three)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.groups(df, 3, 90).collect()}
    assert got == {0: (10, 0), 1: (10, 0), 2: (10, 0), 3: (10, 3), 4: (10, 3)}


def test_sketches_rule_out_no_link():
    rng = np.random.default_rng(5)
    for n in (1, 3, 20, 200, 3000):
        for changed in (0, 1, n // 20, n // 5, n // 2):
            x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            y = np.unique(np.concatenate((x[changed:], rng.integers(0, 1 << 63, rng.integers(0, changed + 1), dtype=np.uint64))))
            apart = len(np.setxor1d(x, y))
            assert ngram_join.apart_at_least(ngram_join.sketch(x), ngram_join.sketch(y)) <= apart
            both = len(np.intersect1d(x, y))
            for percent in (80, 90):
                if both and 100 * both >= percent * (len(x) + len(y) - both):
                    assert apart <= ngram_join.most_apart(len(x), len(y), percent, False)
    far = [np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64)) for _ in range(2)]
    assert ngram_join.apart_at_least(*map(ngram_join.sketch, far)) > ngram_join.most_apart(300, 300, 80, True)


def test_satellites_meet_without_their_leader(spark):
    """Many copies that share a change which their leader lacks, each with changes of its own."""
    rng = random.Random(11)
    base = [rng.choice(WORDS) for _ in range(200)]
    changed = [*base[:40], *(f"new{i}" for i in range(30)), *base[70:]]
    docs = [(0, " ".join(base))]
    for i in range(1, 60):
        w = list(changed)
        for k in rng.sample(range(len(w)), i % 4):
            w[k] = f"own{i}_{k}"
        docs.append((i, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.groups(df, 3, 90).collect()}
    assert got == brute_components(docs, 3, 90)


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 60)] + [(7, 7)]
    got = {r.node: r.component for r in ngram_join.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and all(got[100 + k] == 100 for k in range(1, 60))


def test_prefix_and_difference_bounds():
    rng = np.random.default_rng(5)
    for _ in range(400):
        n, percent = int(rng.integers(5, 60)), int(rng.choice([80, 90]))
        leader = np.unique(rng.integers(0, 1 << 60, n).astype(np.uint64))
        pool = rng.integers(0, 1 << 60, 12).astype(np.uint64)

        def change(leader=leader, pool=pool):
            kept = leader[rng.random(len(leader)) > rng.random() * 0.3]
            return np.unique(np.concatenate((kept, rng.choice(pool, rng.integers(0, 8)))))

        a, b = change(), change()
        both = len(np.intersect1d(a, b))
        if 100 * both < percent * (len(a) + len(b) - both) or not both:
            continue
        (la, na, pa), (lb, nb, pb) = ngram_join.delta(a, leader, percent), ngram_join.delta(b, leader, percent)
        if not (na and nb) or (la and lb):
            continue
        roles = [(1, 1)] if not la and not lb else [(0, 2)] if lb else [(2, 0)]
        assert any(set(dict(pa)[x].tolist()) & set(dict(pb)[y].tolist()) for x, y in roles)


def test_shingles_are_those_of_the_words():
    texts = [t for _, t in family(9)] + ["É é " * 9, " a  b\x0bc\x1cd e"]
    assert [len(s) for s in shingles.sets(texts, 3)] == [len(brute_sets(t, 3)) for t in texts]
    a, b = shingles.sets(["A b  C d", "a B c D"], 3)
    assert (a == b).all()


# ---- substrings ----------------------------------------------------------------------------------------------------


def passage(rng, n):
    return " ".join("".join(rng.choice("abcdefghijkl") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def test_cuts_resist_shifts():
    rng = random.Random(3)
    text = passage(rng, 400).encode()
    cut = lambda t: dict(substring.chunk([t]))[0]
    whole, shifted = cut(text), cut(b"some words more " + text)
    far = {x + 16 for x in whole.tolist() if x > 64}
    assert far <= set(shifted.tolist()) and 30 < np.diff(whole).mean() < 80 and np.diff(whole)[:-1].min() >= substring.REACH
    assert cut(b"").tolist() == [0] and cut(b"x").tolist() == [0, 1]


def test_repeated_passages_are_found_and_others_left(spark):
    rng = random.Random(11)
    shared = [passage(rng, 60) for _ in range(4)]
    docs = []
    for i in range(60):
        parts = [passage(rng, rng.randrange(5, 90)) for _ in range(3)]
        if i % 3 == 0:
            parts.insert(rng.randrange(4), shared[i // 3 % 4])
        docs.append((i, "\n".join(parts), "keep"))
    docs += [(60, None, "n"), (61, "", "n"), (62, "x" * 3000, "n"), (63, docs[5][1], "n"), (None, "short", "n")]
    df = spark.createDataFrame(docs, "doc_id long, text string, start string").repartition(3)
    spans = substring.repeated_spans(df).collect()
    assert {r.doc_id for r in spans} == {i for i in range(12, 60, 3)} | {63}
    assert all(r.kept_doc_id < r.doc_id and (r.kept_doc_id % 3 == 0 or r.doc_id == 63) for r in spans)
    left = {r.doc_id: r.text for r in substring.remove_repeats(df).collect()}
    assert left[60] is None and left[61] == "" and left[62] == "x" * 3000 and len(left[63]) < 60 and left[None] == "short"
    texts = dict((i, t) for i, t, _ in docs)
    for i in range(60):
        if i % 3 or i < 12:
            assert left[i] == texts[i]
        else:
            assert len(texts[i]) - len(left[i]) > 0.6 * len(shared[0])
    assert substring.remove_repeats(df).columns == df.columns
    assert substring.repeated_spans(df.limit(0)).count() == 0


def test_passages_of_short_words_and_of_repeated_phrases_are_found(spark):
    rng = random.Random(8)
    little = "the of and to a in is it that for was on are as with his they at be this from or had by but some what we can".split()
    shared = [" ".join(rng.choice(little) for _ in range(51)) for _ in range(60)]
    shared += [(" ".join(rng.sample(little, k)) + " ") * (60 // k) for k in range(1, 6)]
    docs = [(2 * i + k, f"{passage(rng, 40 + rng.randrange(9))} {s} {passage(rng, 40)}") for i, s in enumerate(shared) for k in range(2)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    spans = substring.repeated_spans(df)
    assert spans.columns == ["doc_id", "mark", "start", "length", "chunks", "kept_doc_id"]
    got = spans.collect()
    assert {r.doc_id for r in got} == {2 * i + 1 for i in range(len(shared))} and all(r.kept_doc_id == r.doc_id - 1 for r in got if r.doc_id < 120)
    # what goes is what both texts have
    texts = dict(docs)
    assert all(texts[r.doc_id][r.start : r.start + r.length] in texts[r.doc_id - 1] for r in got if r.doc_id < 120)
    cut = dict(substring.chunk([b"so it is " * 100, b"xy " + b"so it is " * 100, b"x" * 500]))
    assert all(max(np.diff(c).tolist()) <= 64 for c in cut.values())


def test_repetition_within_a_text_only_if_asked(spark):
    rng = random.Random(4)
    p = passage(rng, 60)
    df = spark.createDataFrame([(1, p + " " + passage(rng, 30) + " " + p)], "doc_id long, text string")
    assert substring.repeated_spans(df).count() == 0 and substring.repeated_spans(df, within=True).count() == 1


def test_rows_with_one_id(spark):
    rng = random.Random(6)
    p = passage(rng, 80)
    df = spark.createDataFrame([(1, p), (1, p), (2, p)], "doc_id long, text string")
    assert sorted(len(r.text) for r in substring.remove_repeats(df).collect())[1:] == [len(p), len(p)]


def test_no_shared_passage_of_51_words_is_missed(spark):
    """Brute force: documents that have 51 words in a row in common with one of a smaller id."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    owner, want = {}, set()
    for doc, text in sorted((r.doc_id, r.text) for r in docs.collect() if r.text):
        w = text.split()
        runs = {hash(tuple(w[i : i + 51])) for i in range(len(w) - 50)}
        if any(owner.get(x, doc) < doc for x in runs):
            want.add(doc)
        for x in runs:
            owner.setdefault(x, doc)
    rows = substring.repeated_spans(docs).collect()
    assert len(want) > 50 and want <= {r.doc_id for r in rows}
    assert all(r.kept_doc_id in r.kept_doc_ids and max(r.kept_doc_ids) < r.doc_id for r in rows)
