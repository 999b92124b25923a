import hashlib
import re
import time
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from fieldloom.llm import embed_dup, fingerprint, lattice, near_dup, quality, substring
from fieldloom.llm.queries import op3_fingerprints, op5_substring_removal, op7_near_duplicates, op8_quality, op9_near_vectors, op10_lattice_scores
from tests.llm.helpers import awkward, frame

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def brute_repeats(rows, window):
    seen, out = set(), {}
    for key, text in sorted(rows):
        words = WORD.findall(text)
        covered = [False] * len(words)
        for s in range(len(words) - window + 1):
            w = tuple(words[s : s + window])
            if w in seen:
                covered[s : s + window] = [True] * window
            seen.add(w)
        kept = [w for w, c in zip(words, covered, strict=True) if not c]
        out[key] = (len(words), len(words) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def covered_words(rows, window):
    """The words of each row that a window met before covers."""
    seen, out = set(), []
    for _, text in rows:
        words, covered = WORD.findall(text), set()
        for s in range(len(words) - window + 1):
            w = tuple(words[s : s + window])
            if w in seen:
                covered |= set(range(s, s + window))
            seen.add(w)
        out.append(covered)
    return out


def test_substring_removal(spark):
    want = brute_repeats(texts(spark).items(), 20)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op5_substring_removal(spark, SF).collect()} == want


def with_common_lines():
    rows = [*{r[0]: r for r in awkward(3) if r[0] is not None}.values()]
    line = " ".join(f"common{i}" for i in range(9))
    return rows + [(2000 + i, f"a{i} b{i} {line} c{i} d{i} {line}", "en", "s", 1, "", "") for i in range(12)]


@pytest.mark.parametrize(("batches", "hot", "many"), [(1, substring.HOT, substring.MANY), (4, substring.HOT, substring.MANY), (4, 3, 2)])
def test_substring_batches_hot_seeds_and_cases(spark, batches, hot, many):
    rows = with_common_lines()
    want = brute_repeats([(r[0], r[1] or "") for r in rows], 6)
    got = substring.remove_repeats(frame(spark, rows), window=6, gram=3, batches=batches, hot=hot, many=many, carried=("lang",)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == want
    for r in got:
        assert hashlib.sha256(" ".join(WORD.findall(r.kept_text or "")).encode()).hexdigest() == r.kept_sha256
    assert spark.catalog.listTables() == [] and substring.remove_repeats(frame(spark, [])).count() == 0


@pytest.mark.parametrize(("hot", "many"), [(substring.HOT, substring.MANY), (3, 2)])
def test_substring_repeated_rows(spark, hot, many):
    """Equal rows of one id are one document; different texts of one id, and null ids, are documents of their own."""
    rows = [*{r[0]: r for r in awkward(9) if r[0] is not None}.values()]
    rows.append((3000, " ".join(f"only{i}" for i in range(300)), "en", "s", 1, "", ""))
    rows += [(3, rows[9][1], "en", "s", 1, "", ""), (3, rows[-1][1], "en", "s", 1, "", ""), (None, rows[4][1], None, None, None, None, None), (None, "a lone text of some seven words here", None, None, None, None, None)]

    def order(row):
        return (row[0] is not None, row[0] or 0, hashlib.sha256(row[1].encode()).hexdigest() if row[1] is not None else "")

    want = brute_repeats([(order(r), r[1] or "") for r in rows], 6)
    repeated = [*rows, rows[3], rows[3], rows[5], rows[-1], rows[-5], *[r for r in rows if r[0] == 1004]]
    got = substring.remove_repeats(frame(spark, repeated), window=6, gram=3, hot=hot, many=many).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == Counter((r[0], *want[order(r)]) for r in repeated)


def test_substring_steps_change_no_row(monkeypatch):
    """A slice's rows don't depend on the steps that its words are hashed in, hot seeds and long documents included."""
    rng = np.random.default_rng(5)
    lengths = rng.integers(0, 90, 300)
    lengths[[4, 100]] = 3000
    h = rng.integers(0, 6, lengths.sum()).astype(np.uint64)
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    runs = []
    for words in (1 << 17, 64):
        monkeypatch.setattr(substring, "STEP_WORDS", words)
        runs.append(substring.rows_of_run(h, offsets, np.arange(300) * 7, 9, 4, many=3))
    assert runs[0].equals(runs[1]) and set(runs[0].column("kind").to_pylist()) == {0, 1, 2, 3}


class Captured:
    """A frame that hands back the function that it is to be mapped by."""

    def select(self, *columns):
        return self

    def mapInArrow(self, f, schema):
        return f


@pytest.mark.parametrize("repeated", [False, True])
def test_substring_memory_of_a_batch(repeated):
    """What a task holds beside its batch is bounded, however well the texts are pressed."""
    rng = np.random.default_rng(6)
    names = np.array([f"word{i}" for i in range(400)])
    rows = ["one two three four " * 1000 + str(i) if repeated else " ".join(names[rng.integers(0, 400, 4000)]) for i in range(500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(500), pa.int64()), pa.array(rows)], ["id", "text"])
    pressed = pa.Table.from_batches(substring.pressed(iter([batch]))).combine_chunks().to_batches()
    index = substring.WindowIndex.__new__(substring.WindowIndex)
    index.window, index.gram, index.many = 50, 5, substring.MANY
    tracemalloc.start()
    n = sum(b.num_rows for b in index.seeds(Captured())(iter(pressed)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n and peak < 70e6  # 2 million words; numpy's and Python's memory


def test_substring_hashes_of_words():
    """Words are those of the pattern; equal ones have equal hashes wherever they stand, and others have others."""
    rng = np.random.default_rng(8)
    words = ["a" * n for n in range(1, 200)] + ["a" * n + "\x00" for n in (1, 7, 8, 63, 64)] + ["b" * n + c for n in range(60, 70) for c in "cd"] + ["日本語", "naïve", "x\xa0y", "\x1c", "y" * 50_000]
    gaps = [" ", "\t", "\n", "\x0b", "\x0c", "\r", "  ", " \n"]
    texts = ["".join(words[i] + gaps[g] for i, g in zip(rng.integers(0, len(words), n), rng.integers(0, 8, n), strict=True)) for n in (0, 1, 300, 0, 3000)]
    texts = [None, "", " \n ", *words, " lead", "no end", *texts, None, "last"]
    split = [WORD.findall(t or "") for t in texts]
    for few in (1 << 17, 50):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(substring, "STEP_WORDS", few)
            offsets, h = substring.hashed_words([None if t is None else t.encode() for t in texts])
        assert offsets.tolist() == np.cumsum([0, *map(len, split)]).tolist()
        told = set(zip(sum(split, []), h.tolist(), strict=True))
        assert len(told) == len({w for w, _ in told}) == len({x for _, x in told})
    assert [x.tolist() for x in substring.hashed_words([])] == [[0], []]


def test_substring_cost_of_seeds():
    """Finding the seeds costs a few times what splitting the texts into words does, not ten times."""
    rng = np.random.default_rng(9)
    rows = [" ".join(f"word{i}" for i in rng.integers(0, 10**6, 400)) for _ in range(1500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1500), pa.int64()), pa.array(rows)], ["id", "text"])
    pressed = list(substring.pressed(iter([batch])))
    index = substring.WindowIndex.__new__(substring.WindowIndex)
    index.window, index.gram, index.many = 20, 5, substring.MANY
    line = " ".join(rows).encode()

    def cost(f):
        took = []
        for _ in range(5):
            begin = time.process_time()
            f()
            took.append(time.process_time() - begin)
        return min(took)

    assert cost(lambda: list(index.seeds(Captured())(iter(pressed)))) < 10 * cost(lambda: line.split())


def test_substring_index_takes_batches_later(spark, tmp_path):
    """An index in a folder, opened anew for every batch, finds what brute force finds; levels are merged and read."""
    rows = [(k, r[1] or "") for k, r in enumerate(with_common_lines())]
    want = {k: c for k, c in zip(range(len(rows)), covered_words(rows, 6), strict=True)}
    got, folder = {k: set() for k, _ in rows}, str(tmp_path / "index")
    levels = []
    for k in range(0, len(rows), 17):
        index = substring.WindowIndex(spark, folder, window=6, gram=3, fanout=2, many=2)
        levels.append([len(x) for x in index.levels])
        for r in index.add(spark.createDataFrame(rows[k : k + 17], "doc_id long, text string")).collect():
            got[r.id] |= set(range(r.start, r.start + r.n + 5))
        index.tables.drop()
    assert got == want and any(level[1:] and level[1] for level in levels)
    with pytest.raises(ValueError):
        substring.WindowIndex(spark, folder + "2", window=3, gram=4)


def test_substring_index_of_other_hashes_is_refused(spark, tmp_path, monkeypatch):
    """An index whose words were hashed in another way would find nothing that it holds."""
    substring.WindowIndex(spark, str(tmp_path / "index")).close()
    substring.WindowIndex(spark, str(tmp_path / "index"))
    monkeypatch.setattr(substring, "HASHES", substring.HASHES + 1)
    with pytest.raises(ValueError, match="hashed in another way"):
        substring.WindowIndex(spark, str(tmp_path / "index"))


def brute_components(sets, hundredths=80):
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if 100 * min(len(sets[a]), len(sets[b])) < hundredths * max(len(sets[a]), len(sets[b])):
                continue
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= hundredths * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def shingles(text, n):
    w = WORD.findall(lowered(text))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def test_near_duplicates(spark):
    sets = {i: shingles(t, 2) for i, t in texts(spark).items()}
    want = brute_components(sets)
    for r in op7_near_duplicates(spark, SF).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], r.doc_id == want[r.doc_id])


def chain_of_edits(n, length, seed):
    """Texts of which neighbours are alike and ends are not."""
    rng = np.random.default_rng(seed)
    base = [f"v{seed}x{i}" for i in range(length)]
    for i in range(n):
        base[rng.integers(length)] = f"n{seed}x{i}"
        yield " ".join(base)


@pytest.mark.parametrize(("block", "leaders", "rounds", "bitmaps"), [(512, 16, 2, 2048), (16, 4, 0, 8), (16, 2, 1, 2048)])
def test_near_duplicates_groups_and_cases(spark, monkeypatch, block, leaders, rounds, bitmaps):
    for name, value in (("BLOCK_SETS", block), ("LEADERS", leaders), ("LEADER_ROUNDS", rounds), ("BLOCK_BITMAPS", bitmaps)):
        monkeypatch.setattr(near_dup, name, value)
    rows = [*{r[0]: r for r in awkward(4)}.values()]
    rows += [(5000 + 100 * k + i, t, "en", "s", 1, "", "") for k, (n, length) in enumerate(((60, 60), (40, 30), (50, 200))) for i, t in enumerate(chain_of_edits(n, length, k))]
    sets = {r[0]: shingles(r[1], 5) for r in rows}
    want = brute_components(sets)
    got = near_dup.near_duplicates(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}


def test_near_duplicates_of_repeated_rows(spark):
    """Equal texts have one component whatever their ids; a null id names none."""
    one, other = "a b c d e f g h", "q r s t u v w x"
    rows = [(1, one), (1, one), (2, one), (3, other), (3, one), (4, other), (None, one), (None, None), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dup.near_duplicates(docs).collect()
    want = [(1, 4, 1, True)] * 2 + [(2, 4, 1, False), (3, 4, 1, False), (3, 4, 3, True), (4, 4, 3, False), (None, 4, 1, False), (None, 0, None, True), (5, 0, 5, True)]
    assert Counter(tuple(r) for r in got) == Counter(want)
    assert near_dup.near_duplicates(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        near_dup.near_duplicates(docs, threshold=0.5)


def test_a_bucket_of_many_that_are_not_alike(spark):
    """10,000 bitmaps in one bucket, of which a few pairs are alike: only those families meet."""
    rng = np.random.default_rng(8)
    bits = rng.integers(-(2**63), 2**63 - 1, (10_000, 8))
    bits[5000:5010] = bits[:10]
    rows = spark.createDataFrame([(7, 10_000, i, i, 100, [int(x) for x in r]) for i, r in enumerate(bits)], "band long, members long, id long, c long, n long, sketch array<long>")
    got = sorted((r.a, r.b) for r in near_dup.apart_in_buckets(rows, 0.8).collect())
    assert got == [(i, 5000 + i) for i in range(10)]


@pytest.mark.parametrize(("table", "shingle"), [("sf0.01", 2), ("sf0.01", 5)])
def test_near_duplicates_of_a_table(spark, table, shingle):
    docs = spark.read.parquet(f"/root/testdata/{table}/documents.parquet")
    sets = {r.doc_id: shingles(r.text, shingle) for r in docs.collect()}
    want = brute_components(sets)
    assert {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs, shingle=shingle).collect()} == want


def test_sketch_bits_follow_similarity():
    rng = np.random.default_rng(1)
    for share, most in ((0.9, 50), (0.5, 140)):
        bits = []
        for _ in range(30):
            both = rng.integers(0, 2**63, 400, dtype=np.uint64)
            own = [rng.integers(0, 2**63, int(400 * (1 - share) / share / 2), dtype=np.uint64) for _ in range(2)]
            lows = np.array([near_dup.samples(np.unique(np.concatenate((both, o)))) for o in own])
            sketch = near_dup.bands_and_sketches(lows)[1].view(np.uint64)
            bits.append(int(np.bitwise_count(sketch[0] ^ sketch[1]).sum()))
        assert np.mean(bits) < most and (share < 0.8 or max(bits) <= near_dup.MOST_BITS)
        assert share > 0.8 or np.mean(bits) > near_dup.MOST_BITS


def test_fingerprints(spark):
    docs = texts(spark)
    order = sorted(docs)
    rows = {r.doc_id: r for r in op3_fingerprints(spark, SF).collect()}
    assert sorted(rows) == order
    by_text = defaultdict(set)
    for k, i in enumerate(order):
        text, following = docs[i], docs[order[(k + 1) % len(order)]]
        changed = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        assert rows[i].n_chars == len(text) and rows[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert rows[i].edited_fingerprint == fingerprint.shown(fingerprint.fingerprints([changed])[0])
        assert rows[i].near_next == np.mean(fingerprint.fingerprints([text])[0] == fingerprint.fingerprints([following])[0])
        by_text[text].add(rows[i].fingerprint)
    assert all(len(f) == 1 for f in by_text.values())
    assert np.mean([r.near_edited > r.near_next for r in rows.values()]) > 0.95


def test_samples_agree_as_weighted_sets_do():
    rng = np.random.default_rng(2)
    h = np.sort(rng.integers(0, 2**63, 200, dtype=np.uint64))
    shares, truth = [], []
    for _ in range(60):
        a, b = rng.integers(0, 5, 200), rng.integers(0, 5, 200)
        h = np.sort(rng.integers(0, 2**63, 200, dtype=np.uint64))
        shares.append(np.mean(fingerprint.sample(h[a > 0], a[a > 0]) == fingerprint.sample(h[b > 0], b[b > 0])))
        truth.append(np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(shares) - np.mean(truth)) < 0.03


def test_samples_by_the_formulas():
    """The chosen terms, by the formulas in double precision, one term and sample at a time."""
    import math

    def scrambled(x):
        for _ in range(2):
            x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & (2**64 - 1)
        return x ^ (x >> 32)

    def uniform(x, low, bits):
        return (((x >> low) & (2**bits - 1)) + 0.5) / 2**bits

    rng = np.random.default_rng(12)
    h = np.sort(rng.integers(0, 2**63, 150, dtype=np.uint64))
    w = rng.integers(1, 9, 150)
    chosen = []
    for factor in fingerprint.FACTORS:
        best = (math.inf, 0)
        for term, weight in zip(h.tolist(), w.tolist(), strict=True):
            one = scrambled(term * int(factor) & (2**64 - 1))
            two = scrambled((one + int(fingerprint.SECOND)) & (2**64 - 1))
            r = -math.log(uniform(one, 32, 32) * uniform(one, 0, 32))
            c = -math.log(uniform(two, 43, 21) * uniform(two, 22, 21))
            b = uniform(two, 0, 22)
            level = math.floor(math.log(weight) / r + b)
            best = min(best, (math.log(c) - r * (level - b) - r, term, weight, level))
        chosen.append(best)
    number = [min(scrambled((t + lv % 2**64 * int(fingerprint.SECOND)) % 2**64) >> 32, 2**32 - 2) for _, t, _, lv in chosen]
    assert (fingerprint.sample(h, w) == np.array(number, np.uint32)).mean() > 0.96


def frequent_and_rare(words, seed):
    """Two texts of about as many words: a third of them frequent shared pairs, the others rare ones of their own."""
    rng = np.random.default_rng(seed)
    common = " ".join(f"f{i % 20}" for i in range(words // 3))
    return [common + " " + " ".join(f"{x}" for x in rng.integers(0, 2**60, words * 2 // 3 // 2)) for _ in range(2)]


@pytest.mark.parametrize(("words", "rounds", "most"), [(2000, 12, 0.06), (20_000, 12, 0.06), (500_000, 3, 0.11)])
def test_samples_of_long_texts(words, rounds, most):
    shares, truth = [], []
    for k in range(rounds):
        a, b = frequent_and_rare(words, k)
        found = fingerprint.fingerprints([a, b])
        shares.append(np.mean(found[0] == found[1]))
        p, q = (Counter(zip(["", *t.split()], [*t.split(), ""], strict=True)) for t in (a, b))
        truth.append((p & q).total() / (p | q).total())
    assert abs(np.mean(shares) - np.mean(truth)) < most


def test_held_scores_change_nothing(monkeypatch):
    monkeypatch.setattr(fingerprint, "MOST_TERMS", 4096)
    monkeypatch.setattr(fingerprint, "lately", lambda held=fingerprint.Scores(): held)
    found = [r[1] for r in awkward(10)] * 2 + frequent_and_rare(300, 1)
    for text, samples in zip(found, fingerprint.fingerprints(found), strict=True):
        words = fingerprint.hashes_of(WORD.findall(text or ""))
        assert (fingerprint.sample(*fingerprint.terms(words)) == samples).all()


def test_fingerprint_cases(spark):
    rows = awkward(6)
    got = fingerprint.compare_with_next(frame(spark, [*rows, (None, "x", None, None, None, None, None)])).collect()
    assert Counter(r.doc_id for r in got) == Counter([*[r[0] for r in rows], None])
    empty = {r.fingerprint for r in got if r.n_chars == 0}
    assert len(empty) == 1
    one = fingerprint.compare_with_next(frame(spark, rows[:1])).collect()[0]
    assert one.near_next == 1.0
    assert fingerprint.compare_with_next(frame(spark, [])).count() == 0


def objective(weights, thresholds, rows, grade):
    """Log likelihood of the ordered grades less the decay, a row at a time."""
    import math

    def above(score, k):
        return 1.0 if k == 0 else 0.0 if k > len(thresholds) else 1 / (1 + math.exp(thresholds[k - 1] - score))

    total = 0.0
    for features, g in zip(rows, grade, strict=True):
        score = sum(weights[c] * v for c, v in features.items())
        total += math.log(max(1e-12, above(score, g) - above(score, g + 1)))
    return total - quality.DECAY / 2 * float((weights**2).sum())


def test_fit_is_the_best_near_and_far():
    """No step of one parameter, nor of many, makes the fitted model likelier."""
    rng = np.random.default_rng(6)
    truth = rng.normal(size=8) * 2
    rows = [{int(c): float(v) for c, v in zip(rng.choice(8, 3, replace=False), rng.uniform(0.5, 2, 3), strict=True)} for _ in range(160)]
    scores = np.array([sum(truth[c] * v for c, v in r.items()) for r in rows]) + rng.logistic(size=160)
    grade = np.digitize(scores, [-1.0, 1.5])
    flat = [(i, c, v) for i, r in enumerate(rows) for c, v in r.items()]
    row, col, value = (np.array(x) for x in zip(*flat, strict=True))
    weights, thresholds = quality.fit(row, col, value, grade, 3, rounds=1500)
    assert (weights[8:] == 0).all() and thresholds[0] < thresholds[1]
    best = objective(weights, thresholds, rows, grade)
    for _ in range(60):
        w, t = weights.copy(), thresholds.copy()
        size = rng.choice([0.01, 0.1, 0.5])
        w[:8] += rng.normal(size=8) * size * (rng.random(8) < 0.4)
        t += rng.normal(size=2) * size * (rng.random(2) < 0.4)
        assert objective(w, np.sort(t), rows, grade) <= best + 1e-3
    assert np.corrcoef(weights[:8], truth)[0, 1] > 0.8


def test_grades_of_marks(spark):
    marks = [(1, 1, 0), (2, 0, 0), (3, 1, 1), (4, None, 1), (5, None, 0), (6, 0, None), (7, 1, None), (8, None, None)]
    got = {r.doc_id: r.grade for r in quality.graded(spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()}
    assert got == {1: 2, 2: 1, 3: 0, 4: 0, 5: 2, 6: 1, 7: 2, 8: None}


def test_quality(spark):
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    grades = quality.graded(spark.read.parquet(f"{d}/labels.parquet"))
    train, held = grades.where("doc_id % 2 = 0"), grades.where("doc_id % 2 = 1")
    rated = quality.rate(docs, train).join(held, "doc_id").collect()
    kept = {g: np.mean([r.kept for r in rated if r.grade == g]) for g in (0, 1, 2)}
    assert kept[0] < 0.15 and kept[1] < 0.4 and kept[2] > 0.97
    assert all(1 >= r.tails[0] >= r.tails[1] >= 0 and abs(r.expected_grade - sum(r.tails)) < 1e-9 for r in rated)
    rows = awkward(7)
    assert quality.rate(frame(spark, rows), train.limit(0)).where("kept").count() == len(rows)
    assert len(quality.rate(frame(spark, rows), train.limit(3).withColumn("doc_id", (grades["doc_id"] * 0).cast("long"))).collect()) == len(rows)
    assert op8_quality(spark, SF).count() == 200


def brute_links(x, threshold=0.9):
    """Links of each vector and its component's first, by all pairs in double precision."""
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    near = [np.flatnonzero(unit @ v >= threshold) for v in unit]
    label, counts = np.arange(len(x)), [len(n) - 1 for n in near]
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            return counts, label.tolist()
        label = new[new]


def test_near_vectors_cases(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 64)).astype(np.float32)
    for i in range(300, 600):  # copies of a hot vector, exact ones and others with noise
        x[i] = x[0] if i < 400 else x[0] + rng.normal(size=64) * 0.15 if i < 450 else x[i - 300] + rng.normal(size=64) * rng.uniform(0, 0.5)
    rows = [(i, [float(v) for v in r], i % 7, "clash") for i, r in enumerate(x)]
    odd = [(2000, None), (2001, [0.0] * 64), (2002, [1.0, None] * 32), (2003, [float("nan")] * 64), (2004, []), (None, rows[0][1]), (2005, [1.0] * 3)]
    others = [(2006, [1.0, 2.0]), (2007, [1.0, 2.0]), (2008, [2.0, 1.0]), (2009, [1.0, 0.0, 3.0, 4.0]), (2010, [1.1, 0.0, 3.0, 4.0])]  # other lengths meet their own
    table = spark.createDataFrame([*rows, *[(*r, 1, "") for r in odd + others]], "vec_id long, embedding array<float>, label int, n_links string")
    counts, label = brute_links(x)
    for options in ({}, {"cells": 9, "block_rows": 64}, {"cells": 2, "block_rows": 300}):
        got = {r.vec_id: r for r in embed_dup.near_vectors(table, **options).collect()}
        assert [got[i].n_links for i in range(900)] == counts and [got[i].component_id for i in range(900)] == label
        assert all(got[i].n_links == 0 and got[i].kept for i, _ in odd)
        assert [(got[i].n_links, got[i].component_id, got[i].kept) for i, _ in others] == [(1, 2006, True), (1, 2006, False), (0, 2008, True), (1, 2009, True), (1, 2009, False)]
    assert embed_dup.near_vectors(table.limit(0)).count() == 0


def test_near_vectors_of_repeated_ids(spark):
    """Rows of one id aren't linked with each other; their links are added up."""
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.1]), (3, [1.0, 0.0]), (4, [0.1, 1.0])]
    got = embed_dup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert Counter(tuple(r) for r in got) == Counter({(1, 5, 1, True): 3, (2, 3, 1, False): 1, (3, 3, 1, False): 1, (4, 1, 1, False): 1})


@pytest.mark.parametrize("table", ["sf0.001", "sf0.01"])
def test_near_vectors_query(spark, table):
    d = f"/root/testdata/{table}"
    rows = spark.read.parquet(f"{d}/embeddings.parquet").orderBy("vec_id").collect()
    counts, label = brute_links(np.array([r.embedding for r in rows], np.float32))
    ids = [r.vec_id for r in rows]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in op9_near_vectors(spark, d).collect()}
    assert got == {i: (c, ids[k], ids[k] == i) for i, c, k in zip(ids, counts, label, strict=True)}


@pytest.mark.parametrize(("spread", "cells"), [(2, 50), (3, 10), (8, 20), (64, 10)])
def test_near_vectors_are_exact_over_cells(spark, spread, cells):
    """Vectors whose variance lies in few directions (most pairs near borders), in many cells."""
    rng = np.random.default_rng(spread)
    x = rng.normal(size=(1000, 64)) * np.where(np.arange(64) < spread, 1.0, 0.03)
    x[500:] = x[:500] + rng.normal(size=(500, 64)) * 0.3 * np.where(np.arange(64) < spread, 1.0, 0.03)
    x = x.astype(np.float32)
    counts, label = brute_links(x)
    table = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in embed_dup.near_vectors(table, cells=cells, block_rows=64).collect()}
    assert [got[i].n_links for i in range(1000)] == counts
    assert [(got[i].component_id, got[i].kept) for i in range(1000)] == [(k, k == i) for i, k in enumerate(label)]


def test_near_vectors_of_a_large_table(spark, tmp_path):
    """20,000 vectors with planted copies, a third of them of one vector: all pairs of brute force are found."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    rng = np.random.default_rng(11)
    x = rng.normal(size=(20_000, 32)).astype(np.float32)
    x[8000:14_000] = x[0] + rng.normal(size=(6000, 32)) * 0.1
    x[14_000:] = x[:6000] + rng.normal(size=(6000, 32)) * rng.uniform(0, 0.7, (6000, 1))
    pq.write_table(pa.table({"vec_id": np.arange(20_000), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 32).cast(pa.list_(pa.float32()))}), tmp_path / "x.parquet")
    counts, label = brute_links(x)
    got = embed_dup.near_vectors(spark.read.parquet(str(tmp_path / "x.parquet"))).orderBy("vec_id").toArrow()
    assert got["n_links"].to_pylist() == counts and got["component_id"].to_pylist() == label


def small_pieces():
    names = [lattice.MARK, "a", "b", "ab", lattice.MARK + "a", "ba", "abb"]
    return lattice.Pieces(names, [0.0, -1.0, -2.0, -3.0, -4.0, -5.0, -6.0])


def test_lattice_sums_over_segmentations():
    pieces = small_pieces()
    p = np.array([0.2, 0.1, 0.15, 0.25, 0.1, 0.0, 0.0, 0.1, 0.1])
    with np.errstate(divide="ignore"):
        scores, expected = lattice.word_scores(["ab", "", "é", "a" * 400], pieces, np.log(p), np.array([1.0, 0.0, 0.0, 0.0]))
    by_hand = 0.2 * 0.1 * 0.15 + 0.2 * 0.25 + 0.1 * 0.15
    assert np.exp(scores[0]) == pytest.approx(by_hand) and np.exp(scores[1]) == pytest.approx(0.2)
    assert np.exp(scores[2]) == pytest.approx(0.2 * (0.1 / 256) ** 2)
    assert np.isfinite(scores[3])
    assert expected[3] == pytest.approx(0.2 * 0.25 / by_hand)


def segmentations(s, names):
    """All ways to cut ``s`` into pieces, letters that aren't pieces as bytes."""
    if not s:
        return [[]]
    heads = [s[:n] for n in range(1, len(s) + 1) if s[:n] in names]
    if s[0] not in names:
        heads.append(s[0].encode())
    return [[head, *rest] for head in heads for rest in segmentations(s[len(head.decode() if isinstance(head, bytes) else head) :], names)]


@pytest.mark.parametrize(("rounds", "classes", "whole"), [(0, None, True), (2, "lang", True), (3, None, False)])
def test_documents_against_all_segmentations(spark, monkeypatch, rounds, classes, whole):
    """The whole model by listing segmentations: starting weights, rounds of fitting, whole words, classes."""
    import math
    import zlib

    pieces = small_pieces()
    monkeypatch.setattr(lattice, "pieces_of", lambda path, pieces=pieces: pieces)
    texts = ["ab ba", "ab abb a", "é ab", "ba ba abba", "", None, "b aab", "ab", "babab é"]
    rows = [(i, texts[i % len(texts)], ["en", "de", None][i % 3]) for i in range(30)]
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _, _ in rows}
    assert 2 < sum(held.values()) < 20
    names = pieces.names
    weight = {n: 1 / (lattice.RANK - s) for n, s in zip(names, pieces.scores, strict=True)} | {"byte": 1 / (lattice.RANK + 100), "end": 1 / (lattice.RANK + 100)}
    prob = {n: w / sum(weight.values()) for n, w in weight.items()}

    def of(cut):
        return math.prod((prob["byte"] / 256) ** len(x) if isinstance(x, bytes) else prob[x] for x in cut)

    train = [(t or "").split() for i, t, _ in rows if not held[i]]
    kinds = sorted({w for t in train for w in t})
    for _ in range(rounds):
        counts = dict.fromkeys(prob, 0.0) | {"end": 1.0}
        for w in kinds:
            cuts = [(c, of(c)) for c in segmentations(lattice.MARK + w, names)]
            for c, q in cuts:
                for x in c:
                    counts["byte" if isinstance(x, bytes) else x] += q / sum(q for _, q in cuts) * (len(x) if isinstance(x, bytes) else 1)
        prob = {n: (counts[n] + 0.1) / (sum(counts.values()) + 0.1 * len(prob)) for n in prob}
    langs = {i: x for i, _, x in rows}
    groups = ["de", "en", None] if classes else [None]
    kind_of = {i: langs[i] if classes else None for i in langs}
    by = {g: Counter(w for i, t, _ in rows if not held[i] and kind_of[i] == g for w in [*(t or "").split(), "</s>"]) for g in groups}
    every = Counter()
    for c in by.values():
        every.update(c)
    n_docs = {g: sum(not held[i] and kind_of[i] == g for i in held) for g in groups}
    new = (sum(c == 1 for w, c in every.items() if w != "</s>") + 1) / (every.total() + 2) if whole else 1.0
    near = (1 - new) * lattice.NEAR if classes else 0.0

    def word(w, g):
        lone = prob["end"] if w == "</s>" else sum(map(of, segmentations(lattice.MARK + w, names)))
        return new * lone + (1 - new - near) * by[g][w] / max(1, by[g].total()) + near * every[w] / every.total()

    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.score for r in lattice.score(docs, "", rounds=rounds, class_col=classes, whole_words=whole).collect()}
    for i, t, _ in rows:
        total = sum((n_docs[g] + 0.5) * math.prod(word(w, g) for w in [*(t or "").split(), "</s>"]) for g in groups)
        assert got[i] == pytest.approx(math.log10(total / sum(n_docs[g] + 0.5 for g in groups)))


def test_lattice_scores(spark):
    import math
    import zlib

    docs = texts(spark)
    rows = {r.doc_id: r for r in op10_lattice_scores(spark, SF).collect()}
    assert sorted(rows) == sorted(docs)
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in docs}
    words = {i: WORD.findall(lowered(t)) for i, t in docs.items()}
    counts = Counter(w for i in docs if not held[i] for w in words[i])
    ends = sum(not h for h in held.values())
    total, kinds = sum(counts.values()) + ends, len(counts) + 1
    for i, r in rows.items():
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in words[i]) + math.log10((ends + 0.5) / (total + 0.5 * (kinds + 1)))
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(words[i]) + 1, sum(counts[w] > 0 for w in words[i]) + 1, total)
        assert r.base_score == pytest.approx(base) and r.score < 0
    rows = awkward(8)
    import public_tokenizers

    got = lattice.score(frame(spark, [*rows, (None, "x", None, None, None, None, None)]), public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert len(got) == len(rows) + 1 and all(np.isfinite(r.score) for r in got)
    assert lattice.score(frame(spark, []), public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    table = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = table
        table = corpus_pipeline.save(stage(spark, before, SF), f"test-{name}")
        assert table.columns == names and 0 < table.count()
        if name == "near_duplicates":
            sets = {r.doc_id: shingles(r.text, 5) for r in before.collect()}
            want = brute_components(sets)
            assert sorted(r.doc_id for r in table.collect()) == sorted(i for i in want if want[i] == i)
        if name == "substring_removal":
            want = brute_repeats([(r.doc_id, r.text or "") for r in before.collect()], corpus_pipeline.PASSAGE)
            got = {r.doc_id: hashlib.sha256(" ".join(WORD.findall(r.text or "")).encode()).hexdigest() for r in table.collect()}
            assert got == {i: h for i, (n, removed, h) in want.items() if not removed or removed < n}
            assert all(r.n_chars == len(r.text) for r in table.collect())
    pieces = corpus_pipeline.STAGES[-1][1](spark, table, SF).collect()
    assert sum(r.start == 0 for r in pieces) == table.count()
    assert max(r.offset + r.length for r in pieces) <= 4096


def repeated_rows():
    """Awkward rows with clashing columns, equal rows, several texts of one id, null ids, and passages that repeat."""
    rows = awkward(13)
    passage = " ".join(f"p{i}" for i in range(70))
    rows += [(4000 + i, f"start{i} {passage} end{i} " + " ".join(f"u{i}x{j}" for j in range(120)), "en", f"s{i % 3}", 1, "", "") for i in range(6)]
    rows += [rows[3], rows[3], (3, rows[9][1], "en", "s", 1, "", ""), (3, "an unrelated text of some words here", "en", "s", 1, "", "")]
    rows += [(None, rows[4][1], None, None, None, None, None), (None, "a lone text of seven words here", None, None, None, None, None), (None, "a lone text of seven words here", None, None, None, None, None)]
    return rows


def place_of(doc_id, text):
    """The order of documents: null ids first, then by id; texts of one id by their hash."""
    return (doc_id is not None, doc_id or 0, hashlib.sha256(text.encode()).hexdigest() if text is not None else "")


def test_one_of_each_by_value(spark):
    rows = repeated_rows()
    want = {place_of(*r[:2]): r for r in rows}  # equal rows of one id are one document
    order = {place: n for n, place in enumerate(sorted(want))}
    group = brute_components({order[p]: shingles(r[1], 5) for p, r in want.items()})
    kept = Counter((r[0], r[1]) for p, r in want.items() if group[order[p]] == order[p])
    got = corpus_pipeline.one_of_each(spark, frame(spark, rows), SF)
    assert got.columns == frame(spark, rows).columns and Counter((r.doc_id, r.text) for r in got.collect()) == kept
    assert (None, "a lone text of seven words here") in kept and (3, "an unrelated text of some words here") in kept
    assert corpus_pipeline.one_of_each(spark, frame(spark, []), SF).count() == 0


def test_without_repeats_by_value(spark):
    rows = repeated_rows()
    want = brute_repeats({place_of(*r[:2]): r[1] or "" for r in rows}.items(), corpus_pipeline.PASSAGE)
    left = Counter()
    for r in rows:
        n, removed, sha = want[place_of(*r[:2])]
        if not removed or removed < n:
            left[r[0], sha] += 1
    got = corpus_pipeline.without_repeats(spark, frame(spark, rows), SF).collect()
    assert Counter((r.doc_id, hashlib.sha256(" ".join(WORD.findall(r.text or "")).encode()).hexdigest()) for r in got) == left
    assert corpus_pipeline.without_repeats(spark, frame(spark, []), SF).count() == 0


def test_run_on_awkward_rows(spark, tmp_path):
    """All stages in turn, from files; what each keeps is what the next one has, and none is lost on the way."""
    rows = repeated_rows()
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    marks = [(r[0], 1, 0) for r in rows[:40]] + [(None, None, None), (1001, None, None)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    kept = {place_of(*r[:2]): r for r in rows}
    order = {place: n for n, place in enumerate(sorted(kept))}
    group = brute_components({order[p]: shingles(r[1], 5) for p, r in kept.items()})
    texts = {p: r[1] or "" for p, r in kept.items() if group[order[p]] == order[p]}
    left = brute_repeats(texts.items(), corpus_pipeline.PASSAGE)
    worded = Counter(p[1] if p[0] else None for p, (n, removed, _) in left.items() if n > removed)
    found = Counter(r.doc_id for r in pieces if r.start == 0)
    assert set(found) <= set(worded) and sum(found.values()) >= 0.7 * sum(worded.values())  # 1.5 times all words, at most twice a text
    assert all(n <= 2 * worded[i] for i, n in found.items())
    assert sum(r.length for r in pieces) == sum(r.doc_tokens for r in pieces if r.start == 0) and max(r.offset + r.length for r in pieces) <= 4096
    empty = tmp_path / "empty"
    frame(spark, []).write.parquet(str(empty / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(empty / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
