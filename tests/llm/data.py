"""Tables with every oddity the operators must bear, and plain rules that several tests need."""

import itertools

SF = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor " * 20_000
DOCUMENTS = """doc_id long, text string, lang string, source string, n_chars long, score double, node long, fp string,
leaks string, spans string, size long, key string, copy int, turn int, id long, `range` int, figures string, word long"""
PAGES = "page_id long, url string, html string, host string, site string, tokens string, payload_digest string, first string, value string"


def odd_documents(spark):
    """Nulls in each column, empty and very long texts, ties, repeated rows and clashing extra columns."""
    extra = (0.5, 7, "f", "l", "s", 3, "k", 1, 2, 9, 4, "g", 5)
    rows = [
        (1, "plain words in a row", "en", "a", 20), (2, None, "en", "a", None), (3, "", None, None, 0), (None, "no id here at all", "en", None, 5),
        (4, " \t\n ", "en", "b", 4), (5, LONG, "en", "b", len(LONG)), (6, "plain words in a row", "en", "a", 20),
        (1, "plain words in a row", "en", "a", 20), (None, None, None, None, None), (7, "ünïcode — 😀 ſecret K", "xx", "ü", 21),
        (8, "x", "en", "c", 1), (8, "y", "en", "c", 1),
    ]
    return spark.createDataFrame([(*r, *extra) for r in rows], DOCUMENTS)


def no_documents(spark):
    return spark.createDataFrame([], DOCUMENTS)


def odd_pages(spark):
    body = "<html><body><nav><a>menu</a></nav><article><h1>T {0}</h1><p>first {0}<p>second &amp; <b>last</b></article></body></html>"
    long = "<article>" + "<p>many words here</p>" * 20_000 + "</article>"
    rows = [
        (i, f"http://site.example/{i}", body.format(i)) for i in range(6)
    ] + [
        (10, None, body.format("x")), (11, "no address", None), (None, "http://site.example/n", body.format("n")), (12, "http://b.example", ""),
        (13, "http://site.example/13", long), (14, "http://site.example/1\r\n", body.format(1)), (0, "http://site.example/0", body.format(0)),
        (15, "http://c.example/", "<p>broken <b <i>a\" <"), (None, None, None),
    ]
    return spark.createDataFrame([(*r, "h", "s", "t", "p", "f", "v") for r in rows], PAGES)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def plain_components(ids, linked):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in linked:
        root[find(j)] = find(i)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[find(i)] = min(x, least.get(find(i), x))
    return [least.get(find(i)) for i in range(len(ids))]


def plain_shingles(text):
    words = text.lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain_similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def plain_near(rows, limit=0.8):
    sets = [plain_shingles(t) for _, t in rows]
    pairs = itertools.combinations(range(len(rows)), 2)
    return [(i, j) for i, j in pairs if 5 * min(len(sets[i]), len(sets[j])) >= 4 * max(len(sets[i]), len(sets[j])) and plain_similarity(sets[i], sets[j]) >= limit]


def kept_by_brute_force(rows):
    return set(plain_components([i for i, _ in rows], plain_near(rows)))
