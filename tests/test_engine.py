"""The engine: guards, chunks, pairs, registries, stores and streams against plain versions."""

import random

from pyspark.sql import functions as F

from factweave import queries
from factweave.functions import keys
from factweave.operators import chunking, guard, reconcile, registry, vectors
from factweave.operators.facts import first_by_hash, normalize
from factweave.operators.storage import FactStore
from factweave.schemas import VERSION
from factweave.sources import readers
from factweave.streaming import incremental, ingest

FACT = "id long, doc_id long, doc_title string, entity_key string, attribute_key string, attribute_display string, fact_kind string, value_text string, value_num double, currency string, unit_canonical string, period_canonical string, as_of_date string, estimate_status string, basis_flags array<string>, scope_flags array<string>, sanity_flags array<string>, attributed_to string, extraction_confidence double, source_page int, content_hash string"


def fact(id, **over):
    base = {"doc_id": id, "doc_title": f"D{id}", "entity_key": "acme", "attribute_key": "revenue", "attribute_display": "Revenue", "fact_kind": "numeric", "value_text": "1", "value_num": 100.0, "currency": None, "unit_canonical": "number", "period_canonical": None, "as_of_date": None, "estimate_status": None, "basis_flags": [], "scope_flags": [], "sanity_flags": [], "attributed_to": None, "extraction_confidence": 0.8, "source_page": 1, "content_hash": f"h{id}"}
    return tuple([id, *(base | over).values()])


CASES = [
    ({}, {"value_num": 100.4}, "corroborated", "EXACT"),
    ({"value_num": 1005.0}, {"value_num": 1012.0}, "contradiction", "NONE"),
    ({"value_num": 100.0}, {"value_num": 1000.0}, "reconciled", "UNIT_SCALE"),
    ({"period_canonical": "FY:2022-23"}, {"value_num": 150.0, "period_canonical": "FY:2023-24"}, "reconciled", "PERIOD"),
    ({"fact_kind": "status", "unit_canonical": "text", "value_num": None, "value_text": "director", "as_of_date": "2022-05-14"}, {"fact_kind": "event", "unit_canonical": "text", "value_num": None, "value_text": "resigned", "as_of_date": "2023-08-24"}, "reconciled", "TEMPORAL_STATUS"),
    ({"estimate_status": "first_advance"}, {"value_num": 150.0, "estimate_status": "revised"}, "reconciled", "ESTIMATE_VINTAGE"),
    ({"estimate_status": None}, {"value_num": 150.0, "estimate_status": "provisional"}, "contradiction", "NONE"),
    ({"scope_flags": ["per_period"]}, {"value_num": 150.0}, "reconciled", "SCOPE"),
    ({"basis_flags": ["real"]}, {"value_num": 150.0}, "reconciled", "BASIS"),
    ({"attribute_key": "corporate identity number", "fact_kind": "attribute", "unit_canonical": "text", "value_num": None, "value_text": "U63090DL2011PLC221234"}, {"attribute_key": "corporate identity number", "fact_kind": "attribute", "unit_canonical": "text", "value_num": None, "value_text": "L63090DL2011PLC2212345"}, "reconciled", "IDENTIFIER_REVISION"),
    ({"attributed_to": "Agency"}, {"value_num": 150.0}, "unresolved", "ATTRIBUTION"),
    ({}, {"value_num": 150.0, "extraction_confidence": 0.4}, "unresolved", "NONE_LOWCONF"),
    ({"doc_id": 7}, {"doc_id": 7}, "unresolved", "DUPLICATE"),
    ({"unit_canonical": "ratio"}, {}, "unresolved", "INCOMPARABLE"),
    ({"unit_canonical": "text", "value_num": None, "value_text": "Plot 1, 122001"}, {"unit_canonical": "text", "value_num": None, "value_text": "Plot 1, 122002"}, "contradiction", "NONE"),
    ({"value_num": 1.004}, {"value_num": 0.9951}, "contradiction", "NONE"),
    ({"value_num": 10.06}, {"value_num": 10.13}, "corroborated", "ROUNDING"),
    ({"value_num": 1.0049}, {"value_num": 0.9996}, "corroborated", "ROUNDING"),
]


def test_cascade(spark):
    rows = []
    for i, (x, y, _, _) in enumerate(CASES):
        rows += [fact(10 * i + 1, **({"entity_key": f"e{i}"} | x)), fact(10 * i + 2, **({"entity_key": f"e{i}"} | y))]
    out = {r["entity_key"]: r for r in reconcile.relate(spark.createDataFrame(rows, FACT)).collect()}
    got = [(out[f"e{i}"]["bucket"], out[f"e{i}"]["rule_code"]) for i in range(len(CASES))]
    assert got == [c[2:] for c in CASES]
    assert all(r["rule_trace"] and r["explanation"] for r in out.values())


def plain_pairs(facts, cap=60):
    blocks = {}
    for f in sorted(facts):
        blocks.setdefault((f[1], f[2]), []).append(f)
    out = set()
    for block in blocks.values():
        for i, x in enumerate(block):
            for j in range(i + 1, len(block)):
                y = block[j]
                if (j < cap or (x[3] or "") == (y[3] or "")) and not (x[4] and x[4] == y[4]):
                    out.add((x[0], y[0]))
    return out


def test_pairs_and_increments(spark):
    r = random.Random(3)
    facts = [(i, r.choice("ab"), "x", r.choice([None, "", "p", "q"]), r.choice([None, f"h{r.randrange(40)}", f"u{i}"])) for i in range(170)]
    rows = [fact(i, entity_key=e, attribute_key=a, period_canonical=p, content_hash=h) for i, e, a, p, h in facts]
    df = spark.createDataFrame(rows, FACT)
    got = {(x["a_id"], x["b_id"]) for x in reconcile.pair_facts(df).collect()}
    assert got == plain_pairs(facts)
    marked = df.withColumn("is_new", F.col("id") >= 150)
    fresh = {(x["a_id"], x["b_id"]) for x in reconcile.pair_facts(reconcile.touched(marked, marked.where("is_new")), incremental=True).collect()}
    assert fresh == {p for p in got if p[1] >= 150}


def test_store_stream_equals_rebuild(spark, tmp_path):
    r = random.Random(5)
    rows = [fact(i, entity_key=r.choice("abc"), value_num=float(r.choice([100, 100.2, 150])), content_hash=f"h{r.randrange(30)}") for i in range(40)]
    df = spark.createDataFrame(rows, FACT)
    store = FactStore(spark, str(tmp_path / "base"))
    store.migrate()
    assert store.version() == VERSION
    for low in (0, 20):
        incremental.add_facts(store, df.where(F.col("id").between(low, low + 19)))
    rels = {tuple(x) for x in store.read("relations").select("fact_a", "fact_b", "bucket").collect()}
    assert rels
    incremental.add_facts(store, df.where("id >= 20"))  # a replayed batch changes nothing
    assert store.read("facts").count() == len({x[-1] for x in rows})
    assert {tuple(x) for x in store.read("relations").select("fact_a", "fact_b", "bucket").collect()} == rels and store.read("relations").count() == len(rels)
    incremental.rebuild(store)
    assert {tuple(x) for x in store.read("relations").select("fact_a", "fact_b", "bucket").collect()} == rels
    store.update_job(spark.createDataFrame([(1, 1, "parse", "running"), (1, 2, None, "done")], "doc_id long, seq long, stage string, status string"))
    assert store.jobs().select("stage", "status").first() == ("parse", "done")
    store.log_errors(spark.createDataFrame([(1, "e" * 3000, "r" * 9000)], "doc_id long, error string, raw string"))
    row = store.read("extraction_errors").first()
    assert (len(row["error"]), len(row["raw"])) == (2000, 8000)
    docs = incremental.add_documents(store, spark.createDataFrame([("x",), ("y",), ("x",)], "content_sha256 string"))
    assert docs.count() == 2 and incremental.add_documents(store, spark.createDataFrame([("x",)], "content_sha256 string")).count() == 0
    store.reset()
    assert store.read("facts").count() == 0


def test_file_stream(spark, tmp_path):
    landing = tmp_path / "in"
    spark.createDataFrame([fact(1), fact(2, value_num=100.1)], FACT).coalesce(1).write.parquet(str(landing))
    store = FactStore(spark, str(tmp_path / "base"))
    stream = spark.readStream.schema(FACT).parquet(str(landing))
    incremental.follow(store, stream, lambda batch: batch, str(tmp_path / "cp")).awaitTermination()
    assert store.read("relations").count() == 1
    spark.createDataFrame([fact(3)], FACT).coalesce(1).write.mode("append").parquet(str(landing))
    incremental.follow(store, stream, lambda batch: batch, str(tmp_path / "cp")).awaitTermination()
    assert store.read("relations").count() == 3


def test_quote_guard(spark):
    source = "Revenue grew to Rs. 8,142 crore\nin the year under review."
    rows = [("Rs. 8,142 crore", "exact", 16), ("REVENUE   grew to", "exact", None), ("missing words entirely here", "FAIL", None), ("", "FAIL", None), (None, "FAIL", None), ("grew to Rs. 8,142 crores in the yeer", "fuzzy", None), ("zz", "FAIL", None)]
    df = spark.createDataFrame([(i, q, source) for i, (q, _, _) in enumerate(rows)], "k int, quote string, source string")
    checked = guard.verify_quotes(df)
    out = {r["k"]: r for r in checked.collect()}
    for i, (q, match, start) in enumerate(rows):
        assert (out[i]["quote_match"], out[i]["quote_char_start"]) == (match, start), q
    assert source[out[0]["quote_char_start"] : out[0]["quote_char_end"]] == rows[0][0]
    passed, rejected = guard.split_guarded(checked)
    assert passed.count() == 3 and rejected.count() == 4


def test_chunks(spark):
    r = random.Random(1)
    blocks = [(d, p, i, "x" * r.randint(1, 60), r.choice([0.4, 0.85, 0.9])) for d in range(3) for p in range(1, 4) for i in range(r.randint(0, 12))]
    got = [(c["doc_id"], c["page_no"], c["idx"], c["block_ids"], len(c["text"]), c["structural_confidence"]) for c in chunking.chunks(spark.createDataFrame(blocks, "doc_id int, page_no int, idx int, text string, structural_confidence double"), 100).orderBy("doc_id", "idx").collect()]
    expected = []
    for d in range(3):
        n = 0
        for p in range(1, 4):
            held, size = [], 0
            own = [b for b in blocks if b[:2] == (d, p)]
            for k, b in enumerate(own):
                held.append(b)
                size += len(b[3]) + 1
                if size >= 100 or k == len(own) - 1:
                    expected.append((d, p, n, [x[2] for x in held], sum(len(x[3]) for x in held) + len(held) - 1, min(x[4] for x in held)))
                    n, held, size = n + 1, [], 0
    assert got == expected


def test_registry(spark):
    known = ["acme data services", "beta bank"]
    assert registry.link_new_keys(["acme data service", "gamma", "gammas", "acme data services", "gamma"], known, 90) == {"acme data service": "acme data services", "gamma": "gamma", "gammas": "gamma", "acme data services": "acme data services"}
    frame = lambda v: spark.createDataFrame([(x,) for x in v], "key string")
    cand = ["services acme data", "beta bank", "betas bank", "zeta"]
    links = {r["key"]: r["canonical"] for r in registry.best_links(frame(cand), frame(known), 90).collect()}
    plain = {c: max(known, key=lambda k: (keys.key_score(c, k), k)) for c in cand if max(keys.key_score(c, k) for k in known) >= 90}
    assert links == plain
    table = registry.add_aliases(registry.register(spark.createDataFrame([(k, ["old"]) for k in known], "key string, aliases array<string>"), frame(["new", "beta bank"])), registry.best_links(frame(cand), frame(known), 90))
    assert {r["key"]: r["aliases"] for r in table.collect()} == {"acme data services": ["old", "services acme data"], "beta bank": ["betas bank", "old"], "new": []}


def test_normalize_golden(spark):
    raw = spark.createDataFrame([
        (1, 1, "The Company", "Revenue from operations", "Rs. 8,142(1) Cr", "FY24", "numeric", "consolidated revenue", "exact", 0.9, 3),
        (2, 1, "India", "Real GDP growth", "6.4 per cent", "2024-25", "numeric", "first advance estimates of real GDP", "fuzzy", 0.9, 1),
        (3, 1, "The Company", "Revenue from operations", "Rs. 8,142 crore", "FY24", "numeric", "consolidated revenue", "exact", 0.9, 9),
    ], "id long, doc_id long, entity_text string, attribute_label string, value_text string, period_text string, fact_kind string, quote string, quote_match string, self_confidence double, page_no int")
    context = spark.createDataFrame([(1, "Annual", "acme", "2024-05-11")], "doc_id long, doc_title string, primary_entity_key string, published_date string")
    rows = {r["id"]: r for r in normalize(raw, context).collect()}
    a, b, c = rows[1], rows[2], rows[3]
    assert (a["entity_key"], a["attribute_key"], a["value_num"], a["currency"], a["period_canonical"], a["as_of_date"], a["basis_flags"]) == ("acme", "revenue", 8.142e10, "INR", "FY:2023-24", "2024-05-11", ["consolidated"])
    assert (b["attribute_key"], round(b["value_num"], 9), b["estimate_status"], b["period_canonical"], round(b["extraction_confidence"], 9)) == ("real gdp growth", 0.064, "first_advance", "FY:2024-25", round(0.9 * 0.9 * 0.8, 9))
    assert a["content_hash"] == c["content_hash"] != b["content_hash"]
    assert {r["id"] for r in first_by_hash(normalize(raw, context)).collect()} == {1, 2}


def test_replay_and_replies(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"title_contains": "annual", "pages": {"2": [{"entity_text": "Acme", "attribute_label": "Revenue", "value_text": "5", "quote": "q"}]}}')
    chunks = spark.createDataFrame([(1, 2, 0, "first", 0.9), (1, 2, 1, "second", 0.9), (2, 2, 0, "other", 0.9)], "doc_id long, page_no int, idx int, text string, first_confidence double")
    docs = spark.createDataFrame([(1, "The ANNUAL report"), (2, "Deck")], "doc_id long, title string")
    got = readers.provider("replay")(spark, str(tmp_path / "a.json"), chunks, docs).collect()
    assert [(r["doc_id"], r["page_no"], r["source"], r["value_text"], r["self_confidence"]) for r in got] == [(1, 2, "first", "5", 0.7)]
    fact_ = '{"entity_text": "A", "attribute_label": "B", "value_text": "%s", "quote": "q", "self_confidence": 3}'
    replies = spark.createDataFrame([(1, '```json\n{"facts": [' + fact_ % "1" + ",]}\n```"), (2, '{"facts": [' + fact_ % "N/A" + "]}"), (3, "no json"), (4, '{"facts": []}')], "doc_id long, reply string")
    good, bad = readers.replies(replies)
    assert [(r["doc_id"], r["value_text"], r["self_confidence"], r["fact_kind"]) for r in good.collect()] == [(1, "1", 1.0, "attribute")]
    assert sorted(r["doc_id"] for r in bad.collect()) == [2, 3]
    assert readers.provider("off")(spark).count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "b.PDF.pdf").write_bytes(b"x")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.pdf").write_bytes(b"y")
    (tmp_path / "note.txt").write_bytes(b"z")
    import hashlib

    got = {r["stem"]: r["content_sha256"] for r in readers.files(spark, str(tmp_path)).collect()}
    assert got == {"b.PDF": hashlib.sha256(b"x").hexdigest(), "a": hashlib.sha256(b"y").hexdigest()}


def test_quotes_beyond_one_broadcast(spark, monkeypatch):
    found = lambda: sorted(map(tuple, queries.QUERIES["quote_guard_exact"](spark, "/root/testdata/sf0.001").collect()))
    whole = found()
    monkeypatch.setattr(queries, "QUOTES_AT_ONCE", 7)
    assert whole and found() == whole


def test_similar_keys_of_any_length(spark):
    r = random.Random(4)
    own = sorted({"".join(r.choice("abc") for _ in range(r.randint(1, 12))) for _ in range(120)} | {"acmecor", "acmecorp"})
    df = spark.createDataFrame([(k,) for k in own], "key string")
    found = {(x["key"], x["other"]) for x in registry.similar_keys(df, df, 90.0).collect()}
    assert found == {(a, b) for a in own for b in own if keys.key_score(a, b) >= 90.0}
    assert ("acmecor", "acmecorp") in found


def test_link_in_order(spark, tmp_path):
    store = FactStore(spark, str(tmp_path / "base"))
    r = random.Random(8)
    own = ["".join(r.choice("ab") for _ in range(r.randint(6, 14))) for _ in range(60)]
    known = sorted({own[3][:-1] + "b", "zzzzzz", own[5]})
    fresh = spark.createDataFrame([(k, i) for i, k in enumerate(own)], "key string, first int")
    links = registry.link_in_order(fresh, spark.createDataFrame([(k,) for k in known], "key string"), 88.0, store.scratch)
    assert {x["key"]: x["canonical"] for x in links.collect()} == registry.link_new_keys(own, known, 88.0)


def test_replace_is_whole_or_nothing(spark, tmp_path):
    store = FactStore(spark, str(tmp_path / "base"))
    row = lambda k: spark.createDataFrame([(k, [])], "key string, aliases array<string>")
    store.append(row("a"), "entity_registry")
    before = store.read("entity_registry")
    store.replace(store.read("entity_registry").unionByName(row("b")), "entity_registry")
    half = tmp_path / "base" / "entity_registry" / "gen-3"  # a writer that died
    half.mkdir()
    (half / "part-0.parquet").write_bytes(b"torn")
    held = lambda df: sorted(x["key"] for x in df.collect())
    assert held(store.read("entity_registry")) == ["a", "b"] and held(before) == ["a"]
    store.append(row("c"), "entity_registry")
    store.replace(store.read("entity_registry").where("key <> 'a'"), "entity_registry")
    assert held(store.read("entity_registry")) == ["b", "c"]


def test_ingest_documents(spark, tmp_path):
    store = FactStore(spark, str(tmp_path / "base"))
    docs = spark.createDataFrame([("One", "Acme Data Limited\nRevenue was 100 crore in FY24."), ("Two", "Acme Data Limited\nRevenue was 100 crore in FY24.\fRevenue was 150 crore in FY24."), ("One", "Acme Data Limited\nRevenue was 100 crore in FY24."), ("Blank", None)], "title string, text string")

    def propose(chunks, documents):
        said = chunks.join(documents.select("doc_id", "title"), "doc_id").select("title", "doc_id", "page_no", F.col("text").alias("source"), "structural_confidence", F.explode(F.regexp_extract_all("text", F.lit(r"(Revenue was \d+ crore in FY24)"))).alias("quote"))
        who = F.when(F.col("title") == "One", "Acme Data").otherwise("Acme Datas")
        out = said.withColumns({"entity_text": who, "attribute_label": F.lit("Revenue"), "value_text": F.regexp_extract("quote", r"\d+ crore", 0), "unit_text": F.lit(None).cast("string"), "period_text": F.lit("FY24"), "fact_kind": F.lit("numeric"), "self_confidence": F.lit(0.9)})
        return out.unionByName(out.withColumn("quote", F.lit("a quote that nobody wrote down")))

    def out_of_reach(chunks, documents):
        raise ingest.Outage("no model")

    status = lambda: {x["status"] for x in store.jobs().collect()}
    assert not ingest.ingest(store, docs, out_of_reach) and status() == {"paused"}
    assert store.read("documents").count() == 3 and store.read("facts").count() == 0
    assert ingest.extract(store, propose) and status() == {"done"}
    first = {n: store.read(n).count() for n in ("documents", "pages", "raw_facts", "facts", "relations", "rejected_facts")}
    assert first["facts"] == 3 and first["raw_facts"] == 3 and first["rejected_facts"] == 3
    assert store.read("facts").select("entity_key").distinct().count() == 1  # the variant was linked, so the facts meet
    assert {(x["bucket"], x["rule_code"]) for x in store.read("relations").collect()} == {("corroborated", "EXACT"), ("contradiction", "NONE")}
    (entity,) = store.read("entity_registry").collect()
    assert sorted([entity["key"], *entity["aliases"]]) == ["acme data", "acme datas"]
    assert ingest.ingest(store, docs, propose) and {n: store.read(n).count() for n in first} == first


def test_meet_finds_every_quote_once(spark, monkeypatch):
    monkeypatch.setattr(guard, "PAIRS_AT_ONCE", 50)
    r = random.Random(6)
    word = lambda n: "".join(r.choice("abé ß") for _ in range(n))
    texts = [word(r.randint(0, 300)) for _ in range(60)] + ["", "tail" * 9]
    quotes = [word(r.randint(0, 4)) for _ in range(40)] + [t[a : a + r.randint(5, 40)] for t in texts[:40] for a in [r.randint(0, 40)]] + ["tail" * 2, "tail" * 9, "tail" * 10, "tailtai"]
    docs, asked = spark.createDataFrame(list(enumerate(texts)), "d long, t string"), spark.createDataFrame([(i, q, q) for i, q in enumerate(quotes)], "i int, q string, own string")
    out = guard.meet(docs, asked, "t", "q")
    assert out.columns == ["d", "i", "own"]
    assert sorted((x["d"], x["i"]) for x in out.collect()) == [(d, i) for d, t in enumerate(texts) for i, q in enumerate(quotes) if q in t]


def test_quotes_are_verified_in_one_pass(spark):
    plan = guard.verify_quotes(spark.createDataFrame([("a", "b")], "quote string, source string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan


def test_keys_meet_only_if_they_may_be_alike(spark):
    frame = lambda v: spark.createDataFrame([(x,) for x in v], "key string")
    known, marred = [f"supplier#{i:09d}" for i in range(300)], [f"supplier#{i:09d} x" for i in range(300)]
    met = sorted(map(tuple, registry.meeting_keys(frame(marred), frame(known), 90.0).collect()))
    assert met == sorted(zip(marred, known))


def test_similar_keys_of_long_and_odd_forms(spark):
    r = random.Random(14)
    word = lambda: "".join(r.choice("abcde é") for _ in range(r.randint(1, 9)))
    own = {" ".join(word() for _ in range(r.randint(1, 8))) for _ in range(60)} | {"  ", " ", "x" * 60}
    for k in sorted(own):
        at = r.randint(0, len(k))
        own |= {k[:at] + "e" + k[at + r.randint(0, 2) :], " ".join(reversed(k.split()))}
    df = spark.createDataFrame([(k,) for k in own] + [(None,)], "key string")
    for threshold in (90.0, 60.0):
        found = sorted((x["key"], x["other"]) for x in registry.similar_keys(df, df, threshold).collect())
        assert found == sorted((a, b) for a in own for b in own if keys.key_score(a, b) >= threshold)


def test_nearest_vectors_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUERIES_AT_ONCE", 40)
    r = random.Random(5)
    rows = [[r.gauss(0, 1) for _ in range(5)] for _ in range(150)]
    rows += [rows[i % 7] for i in range(40)] + [[2 * x for x in rows[3]], [0.0] * 5, [1.0, None, 0.0, 0.0, 0.0], None, [], [1.0] * 3, [1.0, 2.0, 3.0], [float("nan"), 1.0, 1.0]]
    df = spark.createDataFrame(list(enumerate(rows)) + [(None, rows[0])], "vec_id long, embedding array<double>").repartition(3)
    got = {x["vec_id"]: (x["best_id"], x["similarity"]) for x in registry.nearest_vectors(df, df, -1.0).collect()}
    fit = {i: v for i, v in enumerate(rows) if v and None not in v and any(v) and v[0] == v[0]}
    expected = {}
    for i, v in fit.items():
        score = lambda k: round(sum(a * b for a, b in zip(v, fit[k])) / (sum(a * a for a in v) * sum(b * b for b in fit[k])) ** 0.5, 9)  # noqa: E731, B023
        if others := [k for k in fit if k != i and len(fit[k]) == len(v)]:
            expected[i] = max(others, key=lambda k: (score(k), -k))  # noqa: B023
    nan = len(rows) - 1
    assert [got[i][0] for i in (nan - 2, nan - 1)] == [nan, nan] and got[nan][0] == nan - 2  # NaN is the greatest
    assert {i: k for i, (k, _) in got.items() if i < nan - 2} == {i: k for i, k in expected.items() if i < nan - 2}
    assert set(got) == set(expected) | {nan}


def test_raw_facts_of_one_small_file_are_spread(spark):
    out = queries.QUERIES["normalize_facts"](spark, "/root/testdata/sf0.001")
    assert out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
