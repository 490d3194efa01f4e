import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import pages, stuffing, words

PROSE = "The old gate is kept open until the next storm comes, and nobody has said why it has to be so. "
SPAM = {
    "phrases": "\n".join(["cheap lamp sale", "buy lamp online", "best lamp price"] * 12),
    "comment": "/*\n" + " | ".join(["Cheap Lamp", "LAMP OUTLET", "buy lamp"] * 15) + "\n*/\n",
    "array": "const a = [\n" + "".join(f"  'https://www.x{i}.example/p{i}',\n" for i in range(30)) + "];\n",
    "anchors": "".join(f'<li><a href="http://go.q{i}.example/a?id={i}">zor{i} lamp</a></li>\n' for i in range(30)),
    "bare": "\n".join(f"shop.k{i}.example/item{i} lamp deal" for i in range(30)),
    "tags": "\n".join(f"tags: lamp, sale, cheap, size {i}" for i in range(20)),
    "spans": "\n".join('<span class="tag">lamp</span><span class="tag">sale</span>' for _ in range(30)),
    "hashes": "\n".join("#lamp #sale #cheap #new" for _ in range(20)),
    "articles": "\n".join(f"LAMP-{i * 37} | sale | cheap | lamp new" for i in range(20)),
    "salad": " ".join(f"{a}{b}r" for a in ("bo", "ti", "ka", "mu", "se", "lo", "pi", "da", "fe", "wu") for b in ("nas", "rit", "lom", "kep", "vud", "zan", "mor", "hil", "gef", "tup", "cam", "sol", "bix", "yen", "qua", "dop", "fid", "jas", "wel", "raf")),
    "prices": "\n".join(["cheap lamp sale outlet!!! $9.99"] * 40),
    "accents": " ".join(["günstig schuhe kaufen größe"] * 200),
    "colons": "\n".join(["LAMP_1 :: sale :: cheap"] * 40),
    "few words": "cheap lamp sale, buy lamp now, cheap lamp sale, buy lamp now, buy lamp",
}
FINE = {
    "prose": PROSE * 8,
    "code": "\n".join(f"def pull_{i}(lamp, gate={i}):\n    lamp[{i}] = gate.sale({i})\n    return lamp" for i in range(20)),
    "curated": "\n".join(f"* [zor{i}](https://zor{i}.example/lamp) - {PROSE}" for i in range(15)),
    "lock": "{\n" + "\n".join(f'  "zor{i}": {{ "version": "1.{i}.0", "resolved": "https://reg.example/zor{i}.tgz" }},' for i in range(30)) + "\n}",
    "log": "\n".join(f"2015-07-15T00:{i:02d}:00Z INFO lamp: sale took {i * 7} ms" for i in range(40)),
    "words": "\n".join(f"zor{i}mek" for i in range(60)),
    "table": "id,lamp,at\n" + "\n".join(f"{i},zor{i},0.{i * 31},2014-05-{i % 28 + 1:02d}" for i in range(40)),
    "imports": "\n".join(f"import lamp{i % 5}" for i in range(40)),
    "half": PROSE * 5 + "\n" + "\n".join(["cheap lamp sale"] * 12),
    "stuffed code": "/* " + ", ".join(["cheap lamp"] * 40) + " */\n" + "\n".join(f"x{i} = f(y[{i}], {{'a': {i}}});" for i in range(40)),
    "short": "lamp lamp lamp",
    "blank": "  \n ",
    "empty": "",
}


def _background(rng, n):
    """Sentences and statements, of many words, as others write them."""
    noun = [f"n{i}" for i in range(80)]
    forms = [
        "The {} is kept with a {} until it {} to go.",
        "The old {} is kept {} until the next {} comes, and nobody {} said why {} has to be {}.",
        "Nobody has {} why the {} is kept open {} the next {} has to {}, and why it {} to be so.",
    ]
    return [" ".join(rng.choice(forms).format(*rng.choices(noun, k=7)) for _ in range(12)) for _ in range(n)]


def _column(texts):
    return pa.array([t.encode() for t in texts], pa.binary())


def _corpus(texts, least=1.5):
    """Counts of a corpus of single texts, without Spark."""
    w = words.words_of(_column(texts), wide=True)
    tables = []
    for _, hashes, counts in stuffing.word_and_pair_counts(w, np.ones(len(texts))):
        keys, n = stuffing._added(hashes, counts)
        tables.append(stuffing.Table.of(keys[n >= least], n[n >= least]))
    nothing = stuffing.Table(*stuffing._NOTHING)
    return stuffing.Corpus(nothing, *tables, float(len(w.hashes)), least)


@pytest.fixture(scope="module")
def corpus():
    return _corpus([*_background(random.Random(1), 300), *SPAM.values(), *FINE.values()])


@pytest.mark.parametrize("name", SPAM)
def test_spam(corpus, name):
    assert stuffing.judge(pages.lines_of(_column([SPAM[name]])), corpus).spam.tolist() == [True]


@pytest.mark.parametrize("name", FINE)
def test_no_spam(corpus, name):
    read = pages.lines_of(_column([FINE[name]]))
    assert stuffing.judge(read, corpus).spam.tolist() == [False]


def test_texts_with_much_code_are_never_spam(corpus):
    read = pages.lines_of(_column([*SPAM.values(), *FINE.values()]))
    found = stuffing.judge(read, corpus)
    assert not (found.spam & (5 * stuffing.code_words(read) >= found.words)).any()


def test_lines():
    text = "See [zor](https://zor.example/a?b=1), <b>bold</b> x = f(y) and a | b\n'www.k1.example/x',\n\"github.com/foo/bar\"\nshop.k2.example/item2 lamp\n[url=http://u.example/v]deal[/url]\n#lamp #sale\n\"key\": 3\nimport lamp\n3 4"
    p = pages.lines_of(_column(["", text, "last"]))
    w = p.words
    word = [bytes(w.raw[a:b]).decode() for a, b in zip(w.starts, w.ends, strict=True)]
    of = lambda flags: [x for x, f in zip(word, flags, strict=True) if f]
    assert of(p.link) == "https zor example a b 1 www k1 example x shop k2 example item2 http u example v".split()
    assert of(p.markup) == ["b", "b", "url", "url"]
    assert [(word[i], word[i + 1]) for i in p.pairs[p.hard]] == [("See", "zor"), ("x", "f"), ("f", "y"), ("y", "and"), ("github", "com"), ("key", "3")]
    assert ("a", "b") in [(word[i], word[i + 1]) for i in p.pairs[p.parted & ~p.hard]]
    assert p.links.tolist() == [1, 1, 0, 1, 1, 0, 0, 0, 0, 0] and np.flatnonzero(p.tags).tolist() == [5] and np.flatnonzero(p.keyed).tolist() == [6]
    assert np.flatnonzero(p.imports).tolist() == [7] and p.text.tolist() == [1] * 9 + [2] and of(p.number) == ["1", "3", "3", "4"]


def test_stuffed_documents_are_found_among_others(spark):
    rows = [(i, t, "x", 1.0) for i, t in enumerate(_background(random.Random(2), 400))]
    spam = {1000 + i: t for i, t in enumerate(SPAM.values())}
    fine = {2000 + i: t for i, t in enumerate(FINE.values())}
    rows += [(k, t, "x", 1.0) for k, t in (spam | fine).items()] + [(3000, None, "x", 1.0), (None, SPAM["tags"], "x", 1.0), (3001, SPAM["tags"] + "\n" + SPAM["phrases"] * 3000, "x", 1.0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, spam string, counts double").repartition(6)
    assert {r["doc_id"] for r in stuffing.stuffed(df).collect()} == {*spam, 3001}
    told = stuffing.stuffed(df, features=True).collect()
    assert len(told) == len(rows) - 2 and {r["doc_id"] for r in told if r["spam"]} == {*spam, 3001}
    assert stuffing.stuffed(df.limit(0)).count() == 0


def test_a_third_of_the_rows_may_be_copies(spark):
    rows = list(enumerate(_background(random.Random(7), 600)))
    rows += [(10_000 + i, SPAM["anchors"]) for i in range(300)] + [(20_000 + i, SPAM["hashes"]) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert {r["doc_id"] for r in stuffing.stuffed(df).collect()} == {d for d, _ in rows if d >= 10_000}


def test_a_third_of_the_rows_may_be_altered_copies(spark):
    rng = random.Random(9)
    rows = list(enumerate(_background(rng, 1200)))
    wrappers = [("", ""), ("/*\n", "\n*/\n"), ("<ul>\n", "</ul>\n"), ("# \n", "")]
    for i in range(600):  # one word changed, another wrapper
        lines = SPAM[("anchors", "phrases", "salad")[i % 3]].splitlines()
        lines[rng.randrange(len(lines))] += f" r{i}"
        before, after = rng.choice(wrappers)
        rows.append((10_000 + i, before + "\n".join(lines) + after))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(24)
    assert {r["doc_id"] for r in stuffing.stuffed(df).collect()} == {d for d, _ in rows if d >= 10_000}


def test_rare_pairs_arent_needed():
    known = _corpus([*_background(random.Random(3), 300), *SPAM.values(), *FINE.values()], least=50)
    spam = stuffing.judge(pages.lines_of(_column([*SPAM.values(), *FINE.values()])), known).spam
    assert len(known.pairs.keys) < 200 and spam.tolist() == [True] * len(SPAM) + [False] * len(FINE)


def test_short_texts_are_judged_too(spark):
    spam = {1: "tags: lamp, sale, cheap", 2: "#lamp #sale #cheap #new", 3: "https://a.example/x lamp\nhttps://b.example/y sale"}
    fine = {4: "lamp lamp lamp", 5: "import lamp", 6: "The gate is kept open.", 7: '{"lamp": 3}', 8: "...", 9: "", 10: "lamp"}
    df = spark.createDataFrame(list((spam | fine).items()), "doc_id bigint, text string")
    assert {r["doc_id"] for r in stuffing.stuffed(df).collect()} == {*spam}


def test_corpus_counts(spark):
    texts = ["a b a b c", "b c\nc d", "", "c " * 50, "d", "e f " * 4000]
    copies = "k0 " + " ".join(f"k{i}" for i in range(60))
    rows = [t.encode() for t in texts] + [f"{copies} u{i}".encode() for i in range(200)]
    df = spark.createDataFrame([(t,) for t in rows], "text binary").repartition(3)
    corpus = stuffing.corpus_counts(df)
    want, pairs = Counter(), Counter()
    for t in texts:
        own, both = Counter(t.split()), Counter(p for line in t.splitlines() for found in [line.split()] for p in zip(found, found[1:], strict=False))
        for total, counts in ((want, own), (pairs, both)):
            total.update({k: float(np.log2(1 + n)) for k, n in counts.items()})
    h = lambda *w: words.words_of(_column(w), wide=True).hashes
    assert np.allclose(corpus.words.get(h(*"abcdef")), [want[x] if want[x] >= 1.5 else 0 for x in "abcdef"])
    for (a, b), n in pairs.items():
        assert corpus.pairs.get(stuffing.pair_hashes(h(a), h(b)))[0] == pytest.approx(n if n >= 1.5 else 0)
    # a family counts about once, however many copies it has
    assert corpus.pairs.get(stuffing.pair_hashes(h("k7"), h("k8")))[0] < 3
    assert corpus.n < sum(want.values()) + 62 * 3
    least = stuffing.corpus_counts(df, support=2500)
    assert least.least > 8 and least.words.get(h("a", "e")).tolist() == [0, pytest.approx(np.log2(4001))] and len(least.words.keys) <= 2500
