"""Near duplicates, fuzzy lines and decontamination against brute force."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from factweave.llm import clusters, decontaminate, line_dedup, near_dedup
from factweave.llm.textkernel import Words, string_buffers


def bag(text):
    w = text.split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def jaccard(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def groups_of(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def corpus():
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.randint(3, 120))) for _ in range(60)]
    for base in range(0, 30, 3):  # chains of copies of copies
        text = texts[base]
        for _ in range(6):
            w = text.split()
            for _ in range(max(1, len(w) // 60)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            text = " ".join(w)
            texts.append(text)
    return texts + texts[:10] + [f"  {t}\n" for t in texts[10:14]]


def test_near_duplicates_against_brute_force(spark):
    texts = corpus()
    bags = [bag(t) for t in texts]
    links = [(a, b) for b in range(len(texts)) for a in range(b) if jaccard(bags[a], bags[b]) >= 0.8]
    expected = groups_of(len(texts), links)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = {r["doc_id"]: r for r in near_dedup.near_duplicates(docs).collect()}
    assert [found[i]["class_id"] for i in range(len(texts))] == expected
    assert {i for i in found if found[i]["kept"]} == set(expected)
    assert sorted(r["doc_id"] for r in near_dedup.deduplicate(docs).collect()) == sorted(set(expected))


def test_near_duplicates_odd_rows(odd, empty):
    rows = near_dedup.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    left = near_dedup.deduplicate(odd)
    assert left.columns == odd.columns
    texts = Counter(r["text"] for r in left.collect())
    assert all(texts[t] == 1 for t in texts if t and t.split())
    assert texts[None] == 2 and texts[""] == 2  # wordless rows are classes of their own
    assert near_dedup.near_duplicates(empty).count() == 0 and near_dedup.deduplicate(empty).count() == 0


def test_dart_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(3)
    element = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    a = rng.integers(1, 6, 300).astype(float)
    b = np.where(rng.random(300) < 0.3, rng.integers(1, 6, 300), a)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    sig = near_dedup.dart_signatures(np.tile(element, 2), np.concatenate([a, b]), np.repeat([0, 1], 300), 3, k=2000)
    assert abs((sig[0] == sig[1]).mean() - true) < 0.04
    assert not sig[2].any()


def test_words_match_a_plain_reading():
    import pyarrow as pa

    texts = ["a bb\tccc\x0b d", "", None, " x ", "é ü\n\nz", "one two three four five six"]
    words = Words(*string_buffers(pa.array(texts, pa.string())))
    spans = [(r, bytes(words.raw[s:e]).decode()) for r, s, e in zip(words.row, words.start, words.end)]
    import re

    assert spans == [(i, w) for i, t in enumerate(texts) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    assert len(set(words.hashes())) == len({w for _, w in spans})


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(150)] + [(i, i + 1) for i in range(400, 440)]
    found = dict(clusters.components(spark.createDataFrame(edges, "a long, b long")).collect())
    expected = groups_of(441, edges)
    assert found == {x: expected[x] for e in edges if e[0] != e[1] for x in e}


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=14), st.text("abc", max_size=14), st.integers(0, 14))
def test_edit_distance(a, b, most):
    assert line_dedup.edit_distance(a, b, most) == min(plain_distance(a, b), most + 1)


def line_corpus():
    r = random.Random(9)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(300)]
    lines = [" ".join(r.choice(words) for _ in range(r.randint(4, 40))) for _ in range(80)]
    for i in range(0, 60, 2):
        for _ in range(3):
            at = r.randrange(len(lines[i]))
            lines.append(lines[i][:at] + r.choice(["", "x", "7"]) + lines[i][at + 1 :])
    texts = []
    for _ in range(60):
        texts.append("\n".join(r.choice(lines) for _ in range(r.randint(1, 8))))
    return texts


def test_lines_against_brute_force(spark):
    texts = line_corpus()
    places = {}
    for d, text in enumerate(texts):
        for k, line in enumerate(text.split("\n")):
            if len(n := line_dedup.normal(line)) and len(n.split()) >= 5:
                places.setdefault(n, []).append((d, k))
    lines = list(places)
    sim = line_dedup.simhash([x.encode() for x in lines])
    links = [(a, b) for b in range(len(lines)) for a in range(b) if int(sim[a] ^ sim[b]).bit_count() <= 3 and plain_distance(lines[a], lines[b]) <= int(0.1 * max(len(lines[a]), len(lines[b])) + 1e-9)]
    assert links
    root = groups_of(len(lines), links)
    first = {}
    for x, line in enumerate(lines):
        first[root[x]] = min([first.get(root[x], (999, 0)), *places[line]])
    gone = {p for x, line in enumerate(lines) for p in places[line] if p != first[root[x]]}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for r in line_dedup.dedup_lines(docs).collect():
        kept = [x for k, x in enumerate(texts[r["doc_id"]].split("\n")) if (r["doc_id"], k) not in gone]
        assert r["text"] == "\n".join(kept)
        assert r["__lost"] == len(texts[r["doc_id"]].split("\n")) - len(kept)


def test_lines_odd_rows(odd, empty):
    out = line_dedup.dedup_lines(odd)
    rows = out.collect()
    assert out.columns == [*odd.columns, "__lines", "__lost"] and len(rows) == odd.count()
    assert all(r["n_chars"] == len(r["text"]) for r in rows if r["text"] is not None)
    assert line_dedup.dedup_lines(empty).count() == 0


def test_every_line_by_edit_similarity(spark):
    """Recall against edit similarity alone: one letter replaced in lines of five words and more."""
    r = random.Random(11)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(2000)]
    lines = [" ".join(r.choice(words) for _ in range(r.randint(5, 40))) for _ in range(300)]
    marred = []
    for line in lines:
        at = r.randrange(len(line))
        marred.append(line[:at] + "z" + line[at + 1 :])
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines + marred)], "doc_id long, text string")
    alike = sum(line_dedup.alike(a, b) for a, b in zip(lines, marred))
    lost = {x["doc_id"]: x["__lost"] for x in line_dedup.dedup_lines(docs, every=True).collect()}
    assert sum(lost.values()) >= 0.97 * alike and not any(lost[i] for i in range(300))
    assert sum(x["__lost"] for x in line_dedup.dedup_lines(docs).collect()) < 0.9 * alike


def test_every_line_of_few_words(spark):
    texts = ["All rights reserved.\nok\n\n日本語の長い行は一語と数えられるが重複する。", "ok\nall  rights reserved.\n日本語の長い行は一語と数えられるが重複する。", "日本語の長い行は一語と数えられるが重複した。\nall right reserved.\n\nno"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x["text"] for x in line_dedup.dedup_lines(docs, every=True).collect()}
    assert got == {0: texts[0], 1: "", 2: "\nno"}


def best_match(pattern, text):
    """Fewest edits between the pattern and any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(pattern, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return min(row)


def test_decontamination_against_brute_force(spark):
    r = random.Random(4)
    words = ["".join(r.choice("abcdef") for _ in range(r.randint(2, 7))) for _ in range(60)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(i, text(r.randint(8, 30))) for i in range(8)]
    docs = []
    for d in range(60):
        body = text(r.randint(0, 40))
        if d % 2:
            own = list(items[d % 8][1])
            for _ in range(int(len(own) * r.choice([0, 0.05, 0.09, 0.1, 0.11, 0.14]))):
                k = r.randrange(len(own))
                own[k : k + 1] = r.choice([[], ["z"], [own[k], "z"]])
            body = body + "\n" + "".join(own).upper() + " " + text(5)
        docs.append((d, body))
    index = decontaminate.Index(items)
    budget = dict(zip(index.item, index.edits.tolist()))
    expected = {}
    for d, body in docs:
        best = {i: best_match(decontaminate.normal(t), decontaminate.normal(body)) for i, t in items}
        expected[d] = sorted(i for i, n in best.items() if n <= budget[i])
    assert any(expected.values())
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {r["doc_id"]: r for r in decontaminate.contamination(frame, bench).collect()}
    assert {d: list(found[d]["item_ids"]) for d in found} == expected
    assert all(r["kept"] == (not expected[d]) for d, r in found.items())
    assert sorted(r["doc_id"] for r in decontaminate.clean(frame, bench).collect()) == [d for d in expected if not expected[d]]


def test_decontamination_blocks_and_windows(spark, monkeypatch):
    item = " ".join(f"word{i}" for i in range(200))  # longer than a window
    bench = spark.createDataFrame([(1, item), (2, "another passage of moderate size, quite distinct"), (3, None), (4, "")], "item_id long, text string")
    docs = spark.createDataFrame([(1, item[500:1200]), (2, "so: another passage of moderate size, quite distinct."), (3, None), (4, item[:60])], "doc_id long, text string")
    monkeypatch.setattr(decontaminate, "PATTERN_CHARS", 100)
    found = {r["doc_id"]: list(r["item_ids"]) for r in decontaminate.contamination(docs, bench).collect()}
    assert found == {1: [1], 2: [2], 3: [], 4: []}


def test_decontamination_of_short_and_uniform_items(monkeypatch):
    """Budgets of 10 % hold for items of any length, within a document, however often a q-gram occurs."""
    r = random.Random(2)
    for _ in range(60):
        letters = r.choice(["a", "ab", "abcdefgh "])
        items = [(i, "".join(r.choice(letters) for _ in range(r.choice([1, 5, 8, 10, 15, 20, 23, 31, 50, 90])))) for i in range(4)]
        texts = []
        for _ in range(4):
            own = list(r.choice(items)[1])
            for _ in range(r.choice([0, 0, 1, 2, 5])):
                k = r.randrange(len(own)) if own else 0
                own[k : k + 1] = r.choice([[], ["z"], [*own[k : k + 1], "z"]])
            ends = ["".join(r.choice(letters + "xyz") for _ in range(r.randint(0, 30))) for _ in range(2)]
            texts.append(decontaminate.normal(ends[0] + "".join(own) + ends[1]))
        monkeypatch.setattr(decontaminate, "MEETINGS", r.choice([1, 7, 50, 1 << 21]))
        plain = {i: decontaminate.normal(p) for i, p in items}
        for text, found in zip(texts, decontaminate.Index(items).matches(texts)):
            best = {i: best_match(p, text) for i, p in plain.items() if p}
            assert set(found) == {i for i, n in best.items() if n <= int(0.1 * len(plain[i]) + 1e-9)}


def test_decontamination_odd_rows(spark, odd, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    bench = spark.createDataFrame([(1, "x" * 300)], "item_id long, text string")
    assert decontaminate.contamination(odd, none).where("not kept").count() == 0
    assert decontaminate.contamination(odd, bench).where("not kept").count() == 1
    assert decontaminate.clean(odd, bench).columns == odd.columns
    assert decontaminate.clean(odd, bench).count() == odd.count() - 1
    assert decontaminate.contamination(empty, bench).count() == 0


def test_alike_pairs_agree_with_one_by_one():
    r = random.Random(3)
    a, b = [], []
    for n in [1, 5, 9, 12, 20, 30, 60, 100, 319, 320, 330, 700, 3000] * 12:
        x = "".join(r.choice(r.choice(["ab", "abcdefgh", "日本語é"])) for _ in range(n))
        y = list(x)
        for _ in range(int(n * r.choice([0, 0.02, 0.05, 0.09, 0.1, 0.11, 0.2])) + r.choice([0, 1])):
            k = r.randrange(len(y)) if y else 0
            y[k : k + 1] = r.choice([[], ["z"], [*y[k : k + 1], "q"]])
        a, b = [*a, x, "".join(y)], [*b, "".join(y), x]
    assert line_dedup.alike_pairs(a, b).tolist() == [line_dedup.alike(x, y) for x, y in zip(a, b)]
    assert line_dedup.alike_pairs(["", "a", ""], ["", "", "b"]).tolist() == [True, False, False]


def test_buckets_are_compared_in_place():
    """Groups as all pairs of a bucket give them, a pair in its least bucket, and few comparisons in a group of copies."""
    r = random.Random(5)
    value = [r.randrange(300) for _ in range(200)] + [1000 + i % 5 for i in range(400)]
    rows = [(key, i) for key in (7, 9) for i in range(600) if key == 7 or i % 3]
    members = pa.RecordBatch.from_arrays(
        [pa.array([k for k, _ in rows], pa.int64()), pa.array([i for _, i in rows], pa.int64()), pa.array([i for _, i in rows], pa.int64()), pa.array([0] * len(rows), pa.int64()), pa.array([[7, 9] if i % 3 else [7] for _, i in rows], pa.list_(pa.int64()))],
        ["key", "id", "root", "lead", "keys"],
    )
    seen = []

    def judges(part):
        v = np.array([value[i] for i in part.column(1).to_pylist()])
        ids = part.column(1).to_numpy()

        def verify(i, j):
            seen.extend(zip(np.minimum(ids[i], ids[j]).tolist(), np.maximum(ids[i], ids[j]).tolist()))
            return np.abs(v[i] - v[j]) <= 1

        return lambda i, j: np.abs(v[i] - v[j]) <= 20, verify

    batches = [members.slice(low, 77) for low in range(0, len(rows), 77)]
    found = [tuple(x.values()) for b in clusters.linked_within(judges)(iter(batches)) for x in b.to_pylist()]
    alike = [(a, b) for b in range(1, 600) for a in range(1, b) if abs(value[a] - value[b]) <= 1]
    assert set(found) <= set(alike) and groups_of(600, found) == groups_of(600, alike)
    assert len(seen) == len(set(seen)) and sum(a >= 200 for a, _ in seen) < 400 * 399 // 8


def test_profiles_spare_unlike_lines_only():
    r = random.Random(8)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 6))) for _ in range(400)]
    lines = [" ".join(r.choice(words) for _ in range(n)) for n in (8, 20, 40, 60, 60, 90) for _ in range(4)]
    for line in lines[::2]:
        marred = list(line)
        for _ in range(int(0.09 * len(line))):
            marred[r.randrange(len(marred))] = r.choice("xyz ")
        lines.append("".join(marred))
    pairs = [(i, j) for j in range(len(lines)) for i in range(j)]
    i, j = (np.array(x) for x in zip(*pairs))
    most = np.array([int(0.1 * max(len(lines[a]), len(lines[b])) + 1e-9) for a, b in pairs])
    may = line_dedup._may_be(line_dedup._profiles(lines), i, j, most)
    alike = line_dedup.alike_pairs([lines[a] for a in i], [lines[b] for b in j])
    assert alike.sum() >= 12 and not (alike & ~may).any() and may.sum() < 2 * alike.sum()


def test_near_copies_are_judged_in_their_bucket():
    r = random.Random(4)
    base = [f"w{r.randrange(10_000)}" for _ in range(120)]
    texts = [" ".join("x" + w if r.random() < 0.004 * k else w for w in base) for k in range(12)] + ["other words than those before here"]
    text = pa.array(texts)
    signed = next(near_dedup._sign(iter([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), text], ["doc_id", "text"])])))
    bags = next(near_dedup._sets(iter([pa.RecordBatch.from_arrays([text], ["text"])])))
    rows = pa.RecordBatch.from_arrays([*(signed.column(c) for c in near_dedup.SKETCH), bags.column("bag")], [*(f"id_{c}" for c in near_dedup.SKETCH), "bag"])
    near, verify = near_dedup._judges(0.8)(rows)
    i, j = np.triu_indices(len(texts), 1)
    alike = [jaccard(bag(texts[a]), bag(texts[b])) >= 0.8 for a, b in zip(i, j)]
    assert any(alike) and not all(alike) and verify(i, j).tolist() == alike
    assert near(i, j)[np.array(alike)].all() and not near(np.array([0]), np.array([12])).any()


def test_what_belongs_to_an_item_is_joined_once(spark):
    """Eighty items share eight buckets: what is joined to an item comes before it is dealt to them."""
    buckets = spark.createDataFrame([(k, i) for k in range(8) for i in range(80)], "key long, id long")
    sketches = spark.createDataFrame([(i, i) for i in range(80)], "id long, s long")
    seen = []

    def within(members):
        seen.append((members.count(), clusters.by_bucket(members).collect()))
        return members.selectExpr("id as a", "id + 1 as b").where("b < 80")

    def none(pairs):
        return pairs.where("false")

    groups, _ = clusters.clusters(buckets, sketches, lambda x, y: x("s") * 0, 0, none, within=within)
    (items, rows), *more = seen
    assert not more and items == 80 and len(rows) == 640
    assert {(r["key"], r["id"]) for r in rows} == {(k, i) for k in range(8) for i in range(80)}
    assert all(r["keys"] == list(range(8)) and r["root"] == r["id"] == r["id_s"] for r in rows)
    assert {r["root"] for r in groups.collect()} == {0}


def test_sketches_of_items_that_meet_none_are_not_joined_again(spark, monkeypatch):
    buckets = spark.createDataFrame([(i, i) for i in range(500)] + [(1000 + i // 2, i) for i in range(10)], "key long, id long")
    sketches = spark.createDataFrame([(i, i) for i in range(500)], "id long, s long")
    rights = []

    def counted(left, right, on, how, row_bytes=32):
        rights.append(right.count())
        return left.join(right, on, how)

    monkeypatch.setattr(clusters, "join_sized", counted)
    groups, _ = clusters.clusters(buckets, sketches, lambda x, y: x("s") * 0, 0, lambda pairs: pairs)
    assert max(rights) <= 10
    assert {r["id"]: r["root"] for r in groups.collect()} == {i: i - i % 2 for i in range(10)}


def test_few_edits_of_long_lines_need_a_narrow_band(monkeypatch):
    r = random.Random(12)
    a = ["".join(r.choice("abcdefgh ") for _ in range(r.randint(700, 1200))) for _ in range(150)]
    b = []
    for at, line in enumerate(a):
        marred = list(line)
        for k in [0, 350, len(line) - 1] if at < 100 else range(0, len(line), 8 if at % 2 else 14):
            marred[k] = "x"
        b.append("".join(marred))
    expected = [line_dedup.alike(x, y) for x, y in zip(a, b)]
    banded, rows = line_dedup._banded, []

    def seen(longer, shorter, most, width):
        rows.append((width, len(longer)))
        return banded(longer, shorter, most, width)

    monkeypatch.setattr(line_dedup, "_banded", seen)
    assert line_dedup.alike_pairs(a[:100], b[:100]).all() and {width for width, _ in rows} == {1}
    monkeypatch.setattr(line_dedup, "BESIDE", 1)
    assert line_dedup.alike_pairs(a, b).tolist() == expected and expected.count(True) == 125
    assert line_dedup.alike_pairs(a, a[1:] + a[:1]).tolist() == [False] * 150
