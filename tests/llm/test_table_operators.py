"""Operators on whole tables, and the pipeline, against plain versions of the same rules."""

import hashlib
import html
import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from shelfwise.llm import leaks, mixing, quality, registry, secret_scan, simhash, templates, warc
from tests.compare import connect, difference, duck_rows, spark_rows
from tests.llm.data import SF, kept_by_brute_force, no_documents, odd_documents, odd_pages, plain_components, rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet(f"{SF}/pages.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return odd_documents(spark)


def texts(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = connect(SF)
    assert difference(spark_rows(registry.queries()[name](spark, SF)), duck_rows(con, registry.oracle_sql()[name])) is None


def test_every_operator_has_a_query():
    names = registry.queries()
    assert {n.split("_")[0] for n in names if n != "pipeline"} == {f"op{i}" for i in range(1, 14)} and "pipeline" in names


# page templates


def plain_text(page):
    body = re.search("<article>(.*?)(?:</article>|$)", page, re.DOTALL)
    blocks = re.split("</?(?:h1|p|br)>", body[1] if body else "")
    cleaned = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in blocks]
    return " ".join(b for b in cleaned if b)


def test_main_text(pages):
    expected = [(r.page_id, r.url, t := plain_text(r.html), len(t)) for r in pages.collect()]
    assert rows_of(templates.op3_main_text(pages)) == sorted(expected, key=repr)


def test_main_text_of_odd_pages(spark):
    found = odd_pages(spark)
    got = templates.op3_main_text(found).collect()
    assert len(got) == found.count()
    by_id = {}
    for r in got:
        by_id.setdefault(r.page_id, []).append(r.text)
    assert by_id[1] == ["T 1 first 1 second & last"] == by_id[14] and by_id[0] == ["T 0 first 0 second & last"] * 2
    assert by_id[10] == ["T x first x second & last"] and by_id[11] == [""] and by_id[12] == [""]
    assert by_id[13] == [" ".join(["many words here"] * 20_000)] and by_id[15][0].startswith("broken")
    assert templates.op3_main_text(found.limit(0)).collect() == []


def test_marked_parts_go():
    page = """<body class=x><header>top</header><main><h1>A&#32;title</h1><aside>side</aside><div id="cookie-notice">we use</div>
    <p>one<script>var a = "<p>no</p>"</script> two <i>th</i>ree</p><ul><li>four<li>five</ul><form>ask <button>go</button></form>
    <section class="comments">nice!</section><!-- <p>hidden</p> --></main><footer>end</footer></body>"""
    assert templates.main_text(page, {">body.x>main"}) == "A title one two three four five"


def test_classes_come_in_rounds():
    of = {"+a": 1, "-a": 1, "+b": 2, "-b": 2}
    assert templates.in_rounds(["+a", "-a", "+a", "-a", "+b"], of) == {1: True, 2: True}
    assert templates.in_rounds(["+a", "+a", "-a", "-a"], of) == {1: False}
    assert templates.in_rounds(["+a", "-a", "-a"], of) == {1: False}


def test_template_has_the_place_of_text(pages):
    found = templates.deduce(templates._named(pages)).collect()
    assert found and all(templates.place_of_text([t.asDict() for t in r.template]) == {">html>body>article"} for r in found)


# archives


def test_archives_hold_request_capture_and_metadata(spark, pages, tmp_path):
    warc.write_archives(pages, str(tmp_path / "a"))
    found = warc.read_records(spark, str(tmp_path / "a"))
    kinds = {r["type"]: r["count"] for r in found.groupBy("type").count().collect()}
    n = pages.count()
    assert kinds["request"] == kinds["metadata"] == kinds["response"] + kinds.get("revisit", 0) == n
    whole = warc.transactions(found)
    assert whole.count() == n and whole.where("capture IS NULL OR request IS NULL OR metadata IS NULL").count() == 0
    html_of = {r.page_id: r.html.encode() for r in pages.collect()}
    for r in whole.where("capture.type = 'response'").collect():
        assert bytes(r.capture.payload) == html_of[int(r.metadata.http["page-id"])]


def test_archives_of_odd_pages(spark):
    found = odd_pages(spark)
    rows = [(r.page_id, (r.html or "").encode()) for r in found.collect()]
    expected = []
    for page, body in rows:
        same = [p for p, b in rows if b == body and p is not None]
        first = min(same, default=None)
        again = len(body) >= 100 and sum(b == body for _, b in rows) > 1 and page != first
        expected.append((page, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first if again else None))
    assert rows_of(warc.op7_warc(found)) == sorted(expected, key=repr)
    assert warc.op7_warc(found.limit(0)).collect() == []


def test_foreign_archives():
    block = b"HTTP/1.1 200 OK\r\n\r\nbody\r\n\r\nWARC/1.1\r\nstill body"
    record = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <x>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(block), block)
    import gzip

    for data in (record * 2, gzip.compress(record) * 2, gzip.compress(record * 2)):
        assert [(f["warc-record-id"], b) for _, f, b in warc.parse_archive(data)] == [("<x>", block)] * 2
    with pytest.raises(ValueError):
        list(warc.parse_archive(record[:-30]))


def test_transactions_by_way_of_a_request(spark):
    kind = "record_id string, type string, concurrent_to array<string>"
    rows = [("r", "response", ["q"]), ("q", "request", []), ("m", "metadata", ["q"]), ("s", "response", []), ("n", "metadata", ["s"])]
    got = warc.transactions(spark.createDataFrame(rows, kind)).collect()
    assert sorted((r.capture_id, r.request and r.request.record_id, r.metadata and r.metadata.record_id) for r in got) == [("r", "q", "m"), ("s", None, "n")]


# fingerprints


def plain_fingerprint(text, shingle=4):
    words = WORD.findall(low(text))
    if not words:
        return 0
    runs = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize(
    "body",
    [
        '<body class="has-sidebar">{0}</body>', '<body><form id="aspnetForm">{0}</form></body>', '<body class="related">{0}</body>',
        '<body><div class="no-comments widget">{0}</div></body>',
    ],
)
def test_marks_around_the_place_do_not_silence_it(spark, body):
    inner = '<nav>menu</nav><article class="promo"><p>text {0}</p><section class="related-work">work {0}</section><div class="related-posts">More</div><aside>note</aside></article>'
    rows = [(i, f"http://h.example/{i}", f"<html>{body.format(inner.format(i))}</html>") for i in range(8)]
    got = templates.op3_main_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r.page_id: r.text for r in got.collect()} == {i: f"text {i} work {i}" for i in range(8)}


def test_a_form_around_a_page_without_article(spark):
    rows = [(i, f"http://h.example/{i}", f"<body><form><div>text {i}</div><nav>menu</nav></form></body>") for i in range(5)]
    got = templates.op3_main_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r.page_id: r.text for r in got.collect()} == {i: f"text {i}" for i in range(5)}


@pytest.mark.parametrize("extra", ["two articles", "a repeated row"])
def test_one_page_does_not_decide_for_its_host(spark, extra):
    page = "<html><body><article><p>text {0}</p></article><div><p>Teaser box</p></div></body></html>"
    rows = [(i, f"http://h.example/{i}", page.format(i)) for i in range(20)]
    rows += [(20, "http://h.example/20", page.format(20).replace("<div>", "<article>second</article><div>"))] if extra == "two articles" else [rows[3]]
    got = templates.op3_main_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r.page_id: r.text for r in got.collect() if r.page_id < 20} == {i: f"text {i}" for i in range(20)}


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_simhash(table, request):
    df = request.getfixturevalue(table)
    rows = texts(df)
    prints = [plain_fingerprint(t) if len(t) < 50_000 else simhash.fingerprint(t) for _, t in rows]
    near = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if (prints[i] ^ prints[j]).bit_count() <= 4]
    expected = [(i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, plain_components([i for i, _ in rows], near))]
    assert rows_of(simhash.op9_simhash(df)) == sorted(expected, key=repr)


@pytest.mark.parametrize("radius,layout", [(4, simhash.SEGMENTS), (7, ((16, 1),) * 4)])
def test_links_are_all_near_pairs_once(spark, radius, layout):
    rng = random.Random(8)
    values = [rng.getrandbits(64) for _ in range(120)]
    for v in values[:60]:
        for n in (1, 3, 4, 5, 7, 8):
            values.append(v ^ sum(1 << b for b in rng.sample(range(64), n)))
    signed = np.array(sorted(set(values)), np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame([(v, v, v) for v in signed], "node long, fp long, root long")
    got = sorted(map(tuple, simhash.links(nodes, radius, layout).select("a_node", "b_node").collect()))
    assert {tuple(sorted(p)) for p in simhash.head_links(nodes, 0, radius, layout).collect()} <= set(got)
    expected = sorted((min(a, b), max(a, b)) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= radius)
    assert got == expected and len(got) > 100
    with pytest.raises(ValueError):
        simhash.links(nodes, 5, simhash.SEGMENTS)


def test_a_dense_group_needs_few_links(spark):
    rng = random.Random(9)
    centre = rng.getrandbits(64)
    values = {centre ^ sum(1 << b for b in rng.sample(range(64), 2)) for _ in range(600)}
    signed = np.array(sorted(values), np.uint64).view(np.int64).tolist()
    marked = spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long")
    assert {r.component_id for r in simhash.grouped(marked).collect()} == {0}
    nodes = spark.createDataFrame([(v, v, v, 0) for v in signed], "node long, fp long, root long, first_id long")
    for turn in range(2):
        nodes = simhash._merged(nodes, simhash.head_links(nodes, turn, 4, simhash.SEGMENTS))
    assert simhash.links(nodes).count() < len(signed) * 3 < len(signed) * (len(signed) - 1) / 2


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(205, 203), (203, 204)]
    got = dict(map(tuple, simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert {k: got.get(k, k) for e in edges for k in e} == {k: 0 if k < 100 else 100 if k < 200 else 203 for e in edges for k in e}


# mixing


def test_mix_of_odd_rows(spark, odd):
    got = mixing.op5_mixing(odd).collect()
    assert len(got) == odd.count() and rows_of(mixing.op5_mixing(odd)) == sorted(map(tuple, got), key=repr)
    sizes = [len(WORD.findall(t)) for _, t in texts(odd)]
    assert sum(r.taken for r in got) <= sum(r.size for r in got) == sum(sizes)
    assert all(r.taken in (0, r.size, 2 * r.size, 3 * r.size) for r in got)
    assert mixing.op5_mixing(no_documents(spark)).collect() == []


def test_targets_share_what_is_over(spark):
    rows = [("a", 10)] * 3 + [("b", 500)] + [("c", 400)] + [(None, 0)]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    assert got["a"] == 90.0 and got[None] == 0.0 and sum(got.values()) == pytest.approx(930)
    assert got["b"] == pytest.approx(840 * 2 / 3) and got["c"] == pytest.approx(840 / 3)


def test_mix_plan_has_no_python(spark, docs):
    plan = mixing.op5_mixing(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


# leaks


def test_leaks_are_found_and_others_left(spark, docs):
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    words = lambda t: " " + " ".join(re.findall(r"[^\W_]+", low(t))) + " "
    expected = {
        (i, b.item_id) for i, t in texts(docs) for b in benchmark.collect() if words(b.text) in words(t)
    }
    got = {(r.doc_id, r.item_id) for r in leaks.op10_decontamination(docs, benchmark).collect()}
    assert expected and got == expected


def test_leaks_with_changed_words(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    items = [(i, " ".join(word() for _ in range(n)) + ". " + " ".join(word() for _ in range(4))) for i, n in enumerate((9, 30, 36, 90))]
    rows = []
    for i, text in items:
        around = [word() for _ in range(300)]
        parts = text.split()
        changed = [w if rng.random() > 0.2 else word() for w in parts]
        at = rng.randrange(200)
        rows += [(10 * i, " ".join(around[:at] + parts + around[at:])), (10 * i + 1, " ".join(around[:at] + changed + around[at:])), (10 * i + 2, " ".join(around))]
    found = spark.createDataFrame(rows + [(99, None), (98, "")], "doc_id long, text string")
    benchmark = spark.createDataFrame(items + [(50, None), (51, ""), (None, "x")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leaks.op10_decontamination(found, benchmark).collect()}
    assert got == {(10 * i + k, i) for i in range(4) for k in (0, 1)}
    assert leaks.op10_decontamination(found, benchmark.limit(0)).collect() == []
    assert leaks.op10_decontamination(found.limit(0), benchmark).collect() == []


@pytest.mark.parametrize("items,words", [(5000, 8), (2000, 15)])
def test_copies_of_one_item_among_thousands(spark, items, words):
    """Items of common words, beyond the rank of the latent space; every copied one is found, and no clean text."""
    rng = np.random.default_rng(words)
    draw = lambda n: [f"w{k}" for k in np.minimum(rng.zipf(1.25, n), 30_000)]
    benchmark = [(i, " ".join(draw(words))) for i in range(items)]
    rows = []
    for i in range(0, items, items // 200):
        around = draw(120)
        at = int(rng.integers(0, 120))
        rows += [(i, " ".join(around[:at] + benchmark[i][1].split() + around[at:])), (100_000 + i, " ".join(draw(128)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leaks.op10_decontamination(docs, spark.createDataFrame(benchmark, "item_id long, text string")).collect()}
    planted = {(i, i) for i, _ in rows if i < 100_000}
    assert len(planted & got) >= 0.99 * len(planted), len(planted & got)


def test_a_benchmark_beyond_the_bound_is_refused(spark):
    cut = leaks.passages(spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string"))
    assert len(leaks.read_items(cut, 7).ids) == 1
    with pytest.raises(ValueError):
        leaks.read_items(cut, 6)


def test_common_length():
    rng = random.Random(6)
    for _ in range(300):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(1, 25))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        assert leaks.common_length(a, b) == table[-1][-1]


def test_latent_space_keeps_lengths(spark):
    rng = np.random.default_rng(3)
    sets = [sorted(rng.choice(80, 9, replace=False).tolist()) for _ in range(30)]
    idf = rng.uniform(1, 5, 80)
    basis = leaks.latent_space(spark.createDataFrame([(s,) for s in sets], "terms array<long>").repartition(4), idf, 40, 8)
    for s in sets:
        assert np.linalg.norm(idf[s] @ basis[s]) == pytest.approx(np.linalg.norm(idf[s]), rel=1e-4)


# pipeline


def test_stages_of_the_pipeline(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality"](spark, docs, SF)
    ranked = quality.scored(docs, quality.learn(docs, labels, ~quality.held_out(F.col("doc_id"))))
    assert good.columns == docs.columns and rows_of(good) == rows_of(ranked.where("score >= 0.3").drop("score"))

    single = stages["near_duplicates"](spark, docs, SF)
    rows = texts(docs)
    kept = kept_by_brute_force(rows)
    assert {r.doc_id for r in single.collect()} == kept and single.columns == docs.columns and len(kept) < len(rows)

    clean = stages["decontamination"](spark, docs, SF)
    leaked = {r.doc_id for r in leaks.op10_decontamination(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in rows} - leaked and clean.columns == docs.columns

    hidden = stages["secrets"](spark, docs, SF)
    assert hidden.columns == docs.columns and hidden.schema == docs.schema
    assert {r.doc_id: (r.text, r.n_chars) for r in hidden.collect()} == {
        i: (t2 := secret_scan.redacted(t, secret_scan.scan_text(t)), len(t2)) for i, t in rows
    }
    assert rows_of(stages["mixing"](spark, docs, SF)) == rows_of(mixing.op5_mixing(docs))


def test_stages_on_odd_rows(spark, odd):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, odd, SF)
        assert got.columns == odd.columns, name
        assert got.count() <= odd.count()
        assert stage(spark, odd.limit(0), SF).collect() == []
    kept = [r.doc_id for r in corpus_pipeline.near_duplicates_stage(spark, odd, SF).collect()]
    # 1 and 6 are alike, and so are all rows without words; of the rows with id 8 one stays
    assert sorted(kept, key=repr) == sorted([1, 2, 5, 7, 8, None], key=repr)


def test_run_hands_each_stage_what_the_last_one_kept(spark):
    got = {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
    assert got == {r.doc_id for r in docs.collect()}


@pytest.mark.parametrize("edges,steps", [([], 0), ([(1, 5), (7, 1), (9, 8), (5, 1), (3, 3)], 0), ([(1, 2), (3, 2)], 1), ([(1, 2), (2, 3), (3, 4)], 2)])
def test_links_that_are_stars_take_no_step(spark, monkeypatch, edges, steps):
    written, kept = [], simhash.stored
    monkeypatch.setattr(simhash, "stored", lambda df, kind: written.append(kind) or kept(df, kind))
    got = dict(map(tuple, simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    nodes = sorted({n for e in edges for n in e})
    root = dict(zip(nodes, plain_components(nodes, [(nodes.index(a), nodes.index(b)) for a, b in edges])))
    assert got == {n: r for n, r in root.items() if n != r}
    assert len(written) == 1 + 2 * steps


def test_no_links_leave_the_nodes_as_they_are(spark):
    nodes = simhash.stored(spark.createDataFrame([(1, 1, 1)], "node long, fp long, root long"), "nodes")
    assert simhash._merged(nodes, spark.createDataFrame([], "a_root long, b_root long")) is nodes
    assert nodes.collect() == [(1, 1, 1)]
