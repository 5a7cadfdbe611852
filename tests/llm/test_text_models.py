"""HTML extraction, toxicity, quality, licenses, byte BPE, repeated strings."""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import bpe, html, licenses, nbsvm, queries, repeats, toxicity

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
PATH = P.path("byte_bpe_50k.tiktoken")
AWKWARD = [(1, None), (2, ""), (3, " \n\t "), (4, "a" * 300_000), (5, "é中🙂 'll 12"), (5, "é中🙂 'll 12"), (None, "x")]


def _auc(score, label):
    score, label = np.asarray(score, float), np.asarray(label)
    low = np.sort(score[label == 0])
    high = score[label == 1]
    return ((np.searchsorted(low, high, "left") + np.searchsorted(low, high, "right")) / 2).mean() / len(low)


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet="abet hing's12\n é中", max_size=200))
def test_ids_are_those_of_the_library(reference, text):
    own = bpe.codec(PATH, P.PATTERN)
    ids = own.encode(text).tolist()
    assert ids == reference.encode_ordinary(text)
    assert own.decode(ids) == text.encode()


def test_long_pieces_take_linear_time(reference):
    own = bpe.codec(PATH, P.PATTERN)
    for piece in ("ab" * 200_000, "a" * 400_000, "=" * 400_000, "中" * 100_000):
        assert own.decode(own.encode(piece).tolist()) == piece.encode()
    text = "abcdefg" * 300
    assert own.encode(text).tolist() == reference.encode_ordinary(text)


def _merged(ids, text):
    """The parts of a string after merging the lowest rank again and again, the left one of equals first."""
    parts = list(text)
    while found := [(ids[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ids]:
        at = min(found)[1]
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


@given(st.lists(st.text("abc", min_size=2, max_size=5), max_size=12, unique=True), st.randoms(use_true_random=False))
@settings(max_examples=200, deadline=None)
def test_bpe_neighbours_are_those_that_merging_leaves(tokens, random):
    ranks = [*"abc", *tokens]
    random.shuffle(ranks)
    own = bpe.Codec({t.encode(): i for i, t in enumerate(ranks)}, P.PATTERN)
    for left in ranks:
        for right in ranks:
            expected = _merged(own.ids, left + right) == [left, right]
            assert own.together(own.ids[left], own.ids[right]) == expected


def test_bpe_neighbours_merge_once_a_token():
    class Counted(dict):
        looked = 0

        def get(self, *args):
            self.looked += 1
            return super().get(*args)

    own = bpe.codec.__wrapped__(PATH, P.PATTERN)
    tokens = [i for i in range(20_000, 20_400) if 6 <= own.widths[i] <= 10][:60]
    own.ids = Counted(own.ids)
    for left in tokens:
        for right in tokens:
            own.together(left, right)
    assert len(tokens) == 60 and own.ids.looked < 20 * len(tokens) ** 2  # merging each pair's bytes takes about 100


def test_bpe_query(spark, reference):
    got = {r.doc_id: tuple(r)[1:] for r in queries.op8_byte_bpe(spark, SMALL).collect()}
    for row in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        text = row.text or ""
        ids = reference.encode_ordinary(text)
        sums = [hashlib.sha256(x).hexdigest() for x in (" ".join(map(str, ids)).encode(), text.encode())]
        assert got[row.doc_id] == (len(ids), *sums)


def test_bpe_awkward_rows(spark, reference):
    rows = spark.createDataFrame([(k, t, 7) for k, t in AWKWARD], "doc_id long, text string, ids int")
    got = bpe.decode(bpe.encode(rows, PATH, P.PATTERN), PATH, P.PATTERN).collect()
    assert [bytes(r.decoded).decode() for r in got] == [t or "" for _, t in AWKWARD]
    assert [r.ids for r in got] == [reference.encode_ordinary(t or "") for _, t in AWKWARD]
    assert bpe.encode(rows.limit(0), PATH, P.PATTERN).count() == 0


@pytest.mark.parametrize(("query", "label", "least"), [("op5_toxicity", "toxic", 0.75), ("op6_quality_classifier", "quality", 0.95)])
def test_held_out_accuracy(spark, query, label, least):
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet")
    scored = queries.QUERIES[query](spark, MIDDLE)
    assert scored.count() == spark.read.parquet(f"{MIDDLE}/documents.parquet").count()
    rows = scored.join(labels, "doc_id").filter("held_out").toPandas()
    assert rows["score"].between(0, 1).all() and (rows["predicted"] == (rows["score"] >= 0.3)).all()
    assert _auc(rows["score"], rows[label]) > least


def test_models_of_awkward_rows(spark):
    docs = spark.createDataFrame([(k, t, "x") for k, t in AWKWARD], "doc_id long, text string, score string")
    some = spark.createDataFrame([(1, 1), (4, 0), (4, 1), (99, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    for labels, constant in ((some.limit(0), 0.5), (some, 1.0)):
        sample = nbsvm.labelled(docs, labels, "toxic", nbsvm.Settings())
        for scored in (
            nbsvm.score(docs, nbsvm.fit(sample, nbsvm.Settings())),
            toxicity.score(docs, toxicity.fit(docs, labels)),
        ):
            assert [r.score for r in scored.collect()] == [constant] * len(AWKWARD)
    both = spark.createDataFrame([(1, 1), (4, 0), (5, 0)], "doc_id long, toxic int")
    model = nbsvm.fit(nbsvm.labelled(docs, both, "toxic", nbsvm.Settings()), nbsvm.Settings())
    scores = [r.score for r in nbsvm.score(docs, model).collect()] + [
        r.score for r in toxicity.score(docs, toxicity.fit(docs, both)).collect()
    ]
    assert all(0 <= s <= 1 for s in scores)
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), both)).count() == 0


def test_disguised_words_are_restored(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    restore = toxicity.Restorer(toxicity.language_model(toxicity.character_counts(docs)))
    for disguised, plain in {
        "1d10t": "idiot", "m0r0n": "moron", "p4th3t1c": "pathetic", "d1sgu$ting": "disgusting", "i.d.i.o.t": "idiot",
        "cl0wn": "clown", "tr@sh!!": "trash", "stuuupid": "stupid", "thent$$$": "thent", "2024": "2024", "well-known": "well-known",
    }.items():
        assert restore.token(disguised) == plain
    words = toxicity.Reader(restore, lambda found: found).of("you i d i o t and")
    assert ["idiot"] in words


def test_words_disguised_at_edges_in_lists_and_after_other_words_are_seen(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    docs = docs.select("text").unionByName(spark.createDataFrame([("you are a stupid idiot today, asshole and ass " * 50,)], "text string"))
    reader = toxicity.Reader(toxicity.Restorer(toxicity.language_model(toxicity.character_counts(docs))), lambda found: found)
    for text, word in {
        "you are a i d i o t today": "idiot", "y o u i d i o t": "idiot", "s t u p i d " * 100 + "i d i o t": "idiot",
        "1d10t,m0r0n," * 20: "moron", "12345" * 20 + ",1d10t": "idiot", "$tupid": "stupid", "@sshole": "asshole", "!diot": "idiot", "a$$": "ass",
    }.items():
        assert any(word in words for words in reader.of(text)), (text[-30:], reader.of(text))


@given(st.lists(st.text(st.sampled_from("abzéß中🙂"), max_size=11), max_size=20))
@settings(max_examples=200, deadline=None)
def test_numbers_of_many_beginnings(words):
    found = [[] for _ in words]
    for which, numbers in toxicity._numbers(words):
        for i, n in zip(which.tolist(), numbers.tolist(), strict=True):
            found[i].append(n)
    assert found == [[toxicity._number(f) for f in toxicity.beginnings(w)] for w in words]


def test_plain_words_are_weighed_together(monkeypatch):
    weights = {toxicity._number("abc"): 2.0, toxicity._number("dear$"): -1.0, toxicity._number("éé$"): 0.5}
    model = toxicity.Model(np.zeros((64, 64, 64), np.float32), weights)
    texts = ["", "Dear, éé x", "xabc y-z abcdéfghijk.", "dear " + "a 4bc", " ".join(f"w{a}{b}" for a in "xyz" for b in "uvw")]
    one_by_one, calls, number = [max(model.reader.of(t), default=0.0) for t in texts], [], toxicity._number
    monkeypatch.setattr(toxicity, "_number", lambda feature: calls.append(feature) or number(feature))
    assert [max(x, default=0.0) for x in model.reader.of_each(texts)] == one_by_one == [0.0, 0.5, 2.0, 2.0, 0.0]
    monkeypatch.setattr(toxicity, "AT_ONCE", 2)
    assert [max(x, default=0.0) for x in model.reader.of_each(texts)] == one_by_one
    calls.clear()
    model.reader.of("some plain words, that show no sign of disguise.")
    assert not calls


def test_character_counts(spark):
    docs = spark.createDataFrame([(1, "abc déf, " * 30), (2, None), (3, "")], "doc_id long, text string")
    counts = toxicity.character_counts(docs)
    a, b, c = (toxicity._CODE[x] for x in "abc")
    assert counts[(a << 12) | (b << 6) | c] == 30


def test_pages_have_their_article(spark):
    import re
    from html import unescape

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    for row in queries.op4_html_extraction(spark, SMALL).collect():
        inside = pages[row.page_id].split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(unescape(re.sub("<[^>]+>", "\n", b)).split()) for b in re.split("</?(?:p|h1)>", inside)]
        assert row.text == "\n\n".join(b for b in blocks if b) and row.n_chars == len(row.text)


PAGES = [
    ('<body><div class="menu"><a href=x>Home</a></div><div class="content"><h1>Title here</h1><p>A &lt;long&gt; paragraph, it goes on and on.</p>'
     '<div class="ad">Buy this now!</div><p>Second&nbsp;one  with<br>breaks.<form><p>Your name</p></form></div><div id="comments"><p>Nice article, I liked it.</p></div>',
     "Title here\n\nA <long> paragraph, it goes on and on.\n\nSecond one with breaks."),
    ("<body><header><p>Site name</p></header><main><h1>A title</h1><p>Para one.</p><aside><p>See also this.</p></aside><p>Para two is here.</p>"
     "<section class='comments'><p>first!</p></section></main><footer>x</footer>", "A title\n\nPara one.\n\nPara two is here."),
    ('<body><header class="site-header"><nav><a href=/>Home</a></nav></header><div id="cookie-banner"><p>We use cookies. <button>OK</button></p></div>'
     '<aside class="sidebar"><h3>Popular</h3><ul><li><a href=1>One thing</a></li></ul></aside><article class="post"><header><h1>Head line</h1></header>'
     '<p>The quick river ran over the old stone.</p><div class="ad-slot"><p>Buy now, it is cheap!</p></div><ul><li>First item</li><li>Second item</li></ul>'
     '<div class="reader-comments"><p>The quick river ran over the old stone.</p></div></article><form><p>Sign up for our newsletter</p></form><footer><p>© 2020 Site.</p></footer>',
     "Head line\n\nThe quick river ran over the old stone.\n\nFirst item\n\nSecond item"),
    ("<article><p>cut off in the mid", "cut off in the mid"),
    ("<article><script>var x='<p>no</p>'</script><style>p{}</style><!-- <p>no</p> --><p>yes it is", "yes it is"),
    (None, ""), ("", ""), ("<div><br></div>", ""), ("<<<>>&amp", None), ("<p " * 2000, None), ("<div>" * 20_000 + "deep", None), ("</p></b>" * 1000, None),
]


def test_pages_of_other_makes(spark):
    table = spark.read.parquet(f"{SMALL}/pages.parquet")
    rows = spark.createDataFrame([(k, h, "old") for k, (h, _) in enumerate(PAGES)], "page_id long, html string, text string")
    model = html.train(table)
    got = {r.page_id: r.text for r in html.extract(rows, model).collect()}
    for k, (_, want) in enumerate(PAGES):
        assert got[k] is not None and (want is None or got[k] == want)
    assert html.extract(rows.limit(0), html.train(table.limit(0))).count() == 0


def test_elements_left_open_silence_nothing_else():
    def texts(source):
        return [b.text for b in html._Reader().blocks(source)]

    assert texts("<html><head><title>x</title><body><article><p>One.</p></article>") == ["One."]
    assert texts("<head><meta charset=x><script>s</script><p>One.") == ["One."]
    assert texts("<head><title>x</title>Bare text") == ["Bare text"]
    assert texts("<div><button>OK<p>One.</p><button>OK</button></div>") == ["One."]
    assert texts("<div><select><option>A<option>B<p>One.</p></div>") == ["One."]
    assert texts("<div><button><div>OK</div></button><select><option>A<hr><option>B</select><p>One.</p></div>") == ["One."]


def test_viterbi_is_the_best_of_all_labellings():
    from itertools import product

    rng = np.random.default_rng(1)
    crf = html.Crf(rng.normal(size=1 << html.BITS), rng.normal(size=(2, 2)))
    for n in range(1, 8):
        rows = [rng.integers(0, 1 << html.BITS, 3).tolist() for _ in range(n)]

        def value(labels, rows=rows):
            own = sum(crf.weight[r].sum() for r, y in zip(rows, labels, strict=True) if y)
            return own + sum(crf.step[a, b] for a, b in zip(labels, labels[1:], strict=False))

        assert crf.decode(rows) == list(max(product((0, 1), repeat=n), key=value))


def test_licenses_equal_brute_force(spark):
    import re

    def shingles(text):
        words = re.findall("[a-z0-9\x80-\U0010ffff]+", text.lower())
        return [tuple(words[i : i + 5]) for i in range(len(words) - 4)]

    got = {(r.doc_id, r.license) for r in queries.op7_license_scan(spark, SMALL).collect()}
    want = set()
    for row in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        has = set(shingles(row.text or ""))
        for name, text in licenses.TEMPLATES.items():
            wanted = set(shingles(text))
            if len(wanted & has) >= 0.8 * len(wanted):
                want.add((row.doc_id, name))
    assert want and got == want


def test_licenses_awkward_rows(spark):
    notice = licenses.TEMPLATES["BSD"]
    changed = notice.replace("source and", "source or")
    filler = " ".join(f"w{k}" for k in range(3000))
    rows = [(k, t, "x") for k, t in AWKWARD[:5]]
    rows += [(10, f"{filler} {notice.upper()} {filler}", "x"), (11, notice, "x"), (11, notice, "x"), (12, changed, "x"), (13, notice[: len(notice) // 2], "x")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, license string")).collect()
    assert sorted((r.doc_id, r.license, r.word) for r in got) == [(10, "BSD", 3000), (11, "BSD", 0), (11, "BSD", 0)]
    assert licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, license string"), containment=0.6).filter("doc_id = 12").count() == 1
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def _without(rows):
    seen, out = set(), {}
    for key, text in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 99):
            window = data[i : i + 100]
            if window in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(window)
        spans = sum(g and not p for g, p in zip(gone, b"\0" + gone, strict=False))
        out[key] = (len(data), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(data, gone, strict=True) if not g)).hexdigest())
    return out


def test_repeats_equal_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = {r.doc_id: tuple(r)[1:] for r in queries.op9_suffix_dedup(spark, SMALL).collect()}
    assert got == _without(rows)


def test_repeats_of_few_letters(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(5)
    parts = ["".join(rng.choice(list("abé"), n)) for n in (30, 99, 100, 101, 250)] + ["ab" * 80, "x" * 150, ""]
    rows = [(k - 30, "".join(parts[i] for i in rng.integers(0, len(parts), rng.integers(0, 6)))) for k in range(60)]
    rows += [(500, None), (501, "short")]
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, marks string").repartition(5)
    got = repeats.without_repeats(docs).withColumn("kept", F.sha2("kept", 256)).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == _without(rows)
    assert repeats.without_repeats(docs.limit(0)).count() == 0


def test_repeated_rows_and_ids_keep_a_copy(spark):
    one, other = (" ".join(f"{w}{k}" for k in range(60)) for w in ("one", "other"))
    for parts in (1, 4):
        rows = [(1, one), (1, one), (2, other * 2), (2, "short"), (2, other * 2), (3, one + "!")]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = sorted((r.doc_id, bytes(r.kept).decode()) for r in repeats.without_repeats(docs).collect())
        assert got == sorted([(1, one), (1, one), (2, other), (2, "short"), (2, other), (3, "!")])


def test_a_long_text_in_blocks_has_every_window(monkeypatch):
    data = np.random.default_rng(2).integers(97, 99, 5000).astype(np.uint8)
    monkeypatch.setattr(repeats.W, "PIECE", 100)
    starts = [at + first + k for at, block in repeats._blocks(data) for first, n in zip(*repeats.runs(block)[2:4], strict=True) for k in range(n)]
    assert starts == list(range(5000 - 99))
    assert pa.array(starts).null_count == 0


FOREIGN = [
    "<svg/>", "<svg class='icon'/>", "<math/>", "<svg><path d='M0 0'/></svg>", "<svg><svg><g></svg><text>x</text></svg>",
    "<svg><title>icon</title><rect></svg>", "<svg>", "<math><mi>x", "<svg><g>",
]


def test_foreign_elements_leave_the_text_as_it_was(spark):
    """Wherever a block begins, an icon before it changes no text, closed or not."""
    sources = [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").orderBy("page_id").limit(12).collect()]
    reader = html._Reader()
    for i, source in enumerate(sources):
        want = [b.text for b in reader.blocks(source)]
        assert want
        body = source.lower().find("<body")
        starts = [m.start() for m in re.finditer(r"<(?:p|h[1-6]|div|section|ul|article)[\s>]", source) if m.start() > body]
        for at in starts[:: max(1, len(starts) // 15)]:
            icon = FOREIGN[(i + at) % len(FOREIGN)]
            assert [b.text for b in reader.blocks(source[:at] + icon + source[at:])] == want
    assert [b.text for b in reader.blocks("<p>one <svg/>two <math><mi>x</mi></math>three</p><p>four <svg><g>five</p>six")] == [
        "one two three", "four", "six"
    ]
