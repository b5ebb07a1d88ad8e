"""Results against plain versions, the tokenizer libraries, labels that were held out, and bounds."""

import random
import re
import zlib

import numpy as np
import pytest

import brute
from tableworks.llm import html_text, license_scan, merge_dropout, near_dedup, order_minhash, packing, pii, quality_model, quality_rules
from tableworks.llm.labelled_pages import labelled_pages
from tableworks.llm.near_dedup import near_duplicates
from tableworks.llm.token_counts import CHUNK, counter
from tableworks.llm.words import encode, library, tokenizer_path

FOLDER = "/root/testdata/sf0.01"
ODD = ["", " ", "a<|endoftext|>b <|startoftext|>", "It's I'LL they've 1234 ½ ²", "é café İstanbul ΣΑΣ ß ẞ",
       "日本語 テスト　全角 ​  x \x1c a\x1db", "😀😀 👍🏽 a" * 30, "ab" * 1500, "¡Hola! ¿qué? «a» ™ ǅ ŉ", "a </w> b</w>c",
       "▁ ▁x", "a  b\n\n c\td\r\n", "́a é"]


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    return {r.doc_id: r.text for r in rows}


def test_quality_base(texts):
    for text in [*texts.values(), *ODD, "a b c a b c", "a a a a", "a b c\x1cd\n\n \na b c\x1cd", "x y z\r\nx y z"]:
        sequence, distinct = quality_rules.word_numbers(text.encode())
        assert quality_rules.base_counts(text.encode(), sequence, len(distinct)) == brute.base_quality(text)


def _labelled(spark):
    folder = "/root/testdata/sf0.1"
    rows = (spark.read.parquet(f"{folder}/documents.parquet").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
            .select("text", "quality").orderBy("doc_id").limit(1500).collect())
    data, label = [r.text.encode() for r in rows], np.array([r.quality for r in rows], float)
    return data[:1000], label[:1000], data[1000:], label[1000:]


def _area(score, label):
    order = np.argsort(np.argsort(score))
    good = label.sum()
    return (order[label == 1].sum() - good * (good - 1) / 2) / (good * (len(label) - good))


def test_quality_rules_on_held_out_labels(spark):
    data, label, other, truth = _labelled(spark)
    model = quality_rules.fit(data, label)
    p = np.array([quality_rules.probability(quality_rules.raw_score(t, *quality_rules.word_numbers(t), model), model) for t in other])
    assert _area(p, truth) > 0.97
    assert (p[truth == 1] >= quality_rules.LEAST_PROBABILITY).mean() > 0.98
    # calibrated: the mean probability is near the share of good texts
    assert abs(p.mean() - truth.mean()) < 0.1


def test_quality_model_on_held_out_labels(spark):
    data, label, other, truth = _labelled(spark)
    model = quality_model.fit(data, label)
    p = np.array([quality_model.forward(model, quality_model.encode(model, *quality_model.passages(t)), np.zeros(1, np.int64))["p"][0] for t in other])
    assert _area(p, truth) > 0.97 and ((p >= 0.3) == truth).mean() > 0.95


def test_quality_model_gradients():
    random_ = np.random.default_rng(0)
    model = {k: random_.normal(0, 0.5, s) for k, s in quality_model._SHAPES.items()}
    x, bags, label = random_.normal(size=(7, quality_model.SIZE + quality_model._PLAIN)), np.array([0, 3, 4]), np.array([1.0, 0, 1])

    def loss():
        p = quality_model.forward(model, x, bags)["p"]
        return -np.mean(label * np.log(p) + (1 - label) * np.log(1 - p))

    g, _ = quality_model._gradients(model, x, bags, label, quality_model.forward(model, x, bags))
    for key in ("w", "v", "u", "a", "o", "c", "b"):
        at = tuple(0 for _ in model[key].shape)
        model[key][at] += 1e-5
        high = loss()
        model[key][at] -= 2e-5
        low = loss()
        model[key][at] += 1e-5
        assert abs((high - low) / 2e-5 - g[key][at]) < 1e-6


def test_token_counts_and_ids(texts):
    path, some = tokenizer_path(), [*list(texts.values())[:400], *ODD, "x" * 40_000 + " y", ("é" * 99 + " ") * 400]
    want = library(path).encode_batch(some, add_special_tokens=False)
    for text, tokens in zip(some, want):
        assert counter(path).count(text.encode()) == len(tokens.ids)
        assert encode(path, text.encode()) == np.array(tokens.ids, "<u4").tobytes()


def test_chunk_maps_compose(texts):
    know, text = counter(tokenizer_path()), " ".join(list(texts.values())[:60]).encode()
    assert len(text) > 3 * CHUNK
    assert know.count(text) == know._known(text.split())


def test_packing(spark, texts):
    rows = packing.pack_documents(spark.read.parquet(f"{FOLDER}/documents.parquet"), partition_rows=150).collect()
    path, pieces, bins = tokenizer_path(), {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == set(texts)
    for doc, text in texts.items():
        ids = encode(path, text.encode()) + b"\0\0\0\0"
        for r in pieces[doc]:
            assert r.start == r.piece * 2048 and zlib.crc32(ids[r.start * 4:(r.start + r.length) * 4]) == r.ids_crc32
        assert sum(r.length for r in pieces[doc]) == len(ids) // 4
    for members in bins.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert len(bins) <= packing.lower_bound(np.array([r.length for r in rows]), 2048) * 1.01 + 1


def test_packing_bound_never_exceeds_a_packing():
    pick = random.Random(3)
    for _ in range(200):
        lengths = np.array([pick.randint(1, 64) for _ in range(pick.randint(1, 60))])
        bins, offsets, room = packing.best_fit_decreasing(lengths, 64)
        assert packing.lower_bound(lengths, 64) <= len(room)
        assert all(lengths[bins == b].sum() == 64 - room[b] for b in range(len(room)))
    assert packing.lower_bound(np.array([33] * 5), 64) == 5  # the sum alone says 3
    assert packing.lower_bound(np.array([22] * 6), 64) == 3


def test_licences(texts):
    scan = license_scan.scanner().scan
    cases = [*texts.values(), *ODD, "MIT License. GNU General Public License; cc-by CC BY mit\nlicense", "Apache  LICENSE é"]
    for text in cases:
        got = scan(text.encode())
        assert got[:5] == brute.base_licences(text) and 0 <= got[6] <= 1
    for label, template in license_scan.TEMPLATES.items():
        got = scan(f"Some words before. {template} And after.".encode())
        assert label in got[5].split(",") and got[6] > 0.95
        words = template.split()
        words[len(words) // 2] = "changed"
        assert label in scan(" ".join(words).encode())[5].split(",")
    assert scan(b"the software and the public of the license to use free")[5] == ""


def test_labels_come_from_the_automaton(spark):
    """On the lines of the table the added labels are chained spans, and vanish with the automaton."""
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").collect()
    pattern = re.compile(r"\b(?:licen[sc]ed?|rights reserved|cc by)\b", re.I)
    lines = {x for r in rows for x in (r.text or "").split("\n") if pattern.search(x)}
    full, empty = license_scan.scanner(), license_scan.Scanner()
    empty.automaton = license_scan.SuffixAutomaton([])
    added = 0
    for line in lines:
        got, none = full.scan(line.encode()), empty.scan(line.encode())
        assert none[5] == none[4] == got[4] and none[7] == "" and none[6] in (0.0, 0.5)
        spans = [x.rsplit(":", 2)[0] for x in got[7].split(",") if x]
        assert set(got[5].split(",")) - {""} == (set(got[4].split(",")) | set(spans)) - {""}
        added += got[5] != got[4]
    assert added > 0 and len(lines) > 3
    # a statement inside a longer run, and one that is not whole
    assert "mit" in full.scan(b"under the terms of the mit license and more")[5].split(",")
    assert full.scan(b"all rights are reserved, a mit licence") [5] == full.scan(b"mit licence")[5]
    assert full.scan(b"the gnu general public")[5] == ""


def test_short_and_whole_licences(texts):
    scan = license_scan.scanner().scan
    lines = {"This work is licensed under the GNU General Public License, version 3.": "gpl", "All rights reserved.": "proprietary",
             "Licensed under CC BY-NC 4.0.": "cc-by-nc", "Licensed under the Apache License, Version 2.0.": "apache",
             "Released under the MIT License.": "mit", "SPDX-License-Identifier: BSD-3-Clause": "bsd",
             "Distributed under the MIT licence": "mit", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0": "cc-by-nc-sa"}
    for line, label in lines.items():
        got = scan(f"Some words before.\n{line} Some words after it.".encode())
        assert label in got[5].split(",") and got[6] == 1.0 and f"{label}:" in got[7], line
    # the lines of the table reach a label by a span, not only by the base rule
    for line, label in list(lines.items())[:5]:
        having = [scan(t.encode()) for t in texts.values() if line in t]
        assert having and all(f"{label}:" in got[7] for got in having)
    for label, section in license_scan._sections():
        assert label in scan(f"Before. {section}".encode())[5].split(",")
    assert scan(b"all rights are reserved, by cc, released under the tree")[5] == ""


def test_matching_statistics():
    pick = random.Random(1)
    runs = [[pick.randint(0, 3) for _ in range(12)] for _ in range(4)]
    automaton = license_scan.SuffixAutomaton(runs)
    every = {tuple(r[i:j]) for r in runs for i in range(len(r)) for j in range(i + 1, len(r) + 1)}
    text = [pick.randint(0, 4) for _ in range(300)]
    longest = [max((n for n in range(1, 13) if n <= end and tuple(text[end - n:end]) in every), default=0) for end in range(1, 301)]
    want = [(end, n) for end, n in enumerate(longest, 1) if n >= 3 and (end == 300 or longest[end] <= n)]
    got, _ = automaton.matches(text, 3)
    assert [x[:2] for x in got] == want
    for end, n, state in got:
        places = {(r, i + n - 1) for r, run in enumerate(runs) for i in range(13 - n) if run[i:i + n] == text[end - n:end]}
        assert automaton.ends[state] == places


def test_personal_data(spark, texts):
    pick = random.Random(5)
    cases = ["a@b.c_d@e.f", "x@y..z a@b.c.", "1.2.3.4.5.6.7.8 300.1.1.1 0001.2.3.4",
             "😀 a@b.co é 4111 1111 1111 1111 +1 (752) 555-7047", "+1+1 2345678 +", "4111-1111-1111-1111-4111-1111-1111-1111",
             "a" * 30_000 + "@", "9" * 20_000, "a.b@" * 300, "+1 (" * 3000, "4111111111111111," * 300, "4111 1111--4111111111111111 - 1 4111111111111111", "password=abc12345def"]
    cases += ["".join(pick.choice("a1@.+-( )9%_é\n") for _ in range(pick.randint(1, 60))) for _ in range(1000)]
    cases += ["".join(pick.choice("411  -1") for _ in range(pick.randint(10, 90))) for _ in range(1000)]
    rows = [*texts.items(), *((10 ** 6 + n, t) for n, t in enumerate(cases))]
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for key, text in rows:
        assert tuple(got[key])[1:6] == brute.base_pii(text), text[:80]
    assert "secret:0:20" in got[10 ** 6 + cases.index("password=abc12345def")].spans


def test_redaction(spark):
    df = spark.createDataFrame([(1, "😀 a@b.co é 4111 1111 1111 1111 +1 (752) 555-7047!"), (2, "nothing")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.redacted(df).collect()}
    assert got == {1: "😀 [EMAIL] é [CARD] [PHONE]!", 2: "nothing"}


def _redacted(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.redacted(df).collect()}
    listed = {r.doc_id: r.spans for r in pii.personal_data(df).collect()}
    return [got[n] for n in range(len(texts))], [listed[n] for n in range(len(texts))]


def test_spelled_out_addresses(spark):
    forms = ["john (at) example (dot) com", "john [at] example [dot] com", "john(at)example.com", "j.d(at)mail(dot)co(dot)uk",
             "john (at) example (dot) co (dot) uk", "john [at] mail.example.org", "john (at) example . com",
             "john (at) example. com", "a" * 100 + " (at) " + "b" * 70 + " (dot) museum", "a(at)b" + ".c1" * 5000 + ".com"]
    # an at in brackets alone is no address
    plain = ["we met (at) home. Then we left", "x (at) y"]
    got, listed = _redacted(spark, [*(f"write to {f}, or call" for f in forms), *(f"{f}. Then" for f in forms), *plain])
    assert got == ["write to [HANDLE], or call"] * len(forms) + ["[HANDLE]. Then"] * len(forms) + plain
    assert [x for x in listed if x] == [f"handle:9:{9 + len(f)}" for f in forms] + [f"handle:0:{len(f)}" for f in forms]


def test_whole_secrets(spark):
    forms = ["token=" + "a1B2" * 250, "api_key: '" + "x9" * 20_000, "secret=abc12345def",
             "token=eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9PlFUP0THsR8U",
             "token=eyJhbGciOiJkaXIifQ..48V1_ALb6US04U3b.5eym8TW_c8SuK0lt.XFBoMYUZodetZdvT", "pwd=a.b.c.d.e1.f.g"]
    got, listed = _redacted(spark, [*forms, *(f"{f}. The rest" for f in forms)])
    assert got == ["[SECRET]"] * len(forms) + ["[SECRET]. The rest"] * len(forms)
    assert listed == [f"secret:0:{len(f)}" for f in forms] * 2


def test_alignment_against_the_table():
    pick = random.Random(2)
    for _ in range(150):
        words = [f"w{pick.randint(0, 30)}" for _ in range(pick.randint(3, 70))]
        other = [w for w in words if pick.random() > 0.03]
        for _ in range(pick.randint(0, 2)):
            other.insert(pick.randint(0, len(other)), "new")
        left, right = " ".join(words), " ".join(other)
        a, b = (order_minhash.kmers(order_minhash.word_codes(t)) for t in (left, right))
        want = brute.ordered_similarity(left, right)
        got = order_minhash.aligned(a, b)
        if want is not None and want >= 0.8 or got >= 0.8:
            assert got == pytest.approx(want)


def test_near_duplicates(spark):
    pick, rows = random.Random(4), []
    vocabulary = [f"term{i}" for i in range(3000)]
    for group in range(20):
        base = [pick.choice(vocabulary) for _ in range(pick.choice([6, 30, 120, 400]))]
        rows.append(" ".join(base))
        for _ in range(pick.randint(0, 6)):
            copy = list(base)
            for _ in range(pick.randint(0, max(1, len(base) // 25))):
                copy[pick.randrange(len(copy))] = pick.choice(vocabulary)
            rows.append(" ".join(copy) + pick.choice(["", "!"]))
    got = {r.doc_id: r.class_id for r in near_duplicates(
        spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)).collect()}
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if (brute.ordered_similarity(rows[i], rows[j]) or 0) >= 0.8]
    assert [got[i] for i in range(len(rows))] == brute.classes(rows, linked)


def test_only_words_that_pairs_name_are_shuffled(spark, monkeypatch):
    """The words of texts without a candidate are dropped where they are read, in every verification."""
    plans, given, pin, linked = [], [], near_dedup.pin, near_dedup._linked
    monkeypatch.setattr(near_dedup, "pin", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or pin(df))
    monkeypatch.setattr(near_dedup, "_linked", lambda pairs, codes: given.append((pairs, codes)) or linked(pairs, codes))
    pick = random.Random(5)
    rows = [" ".join(f"w{pick.randrange(10 ** 6)}" for _ in range(200)) for _ in range(300)]
    rows += [rows[0] + " more", rows[1] + " more"]
    got = near_duplicates(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4))
    assert got.filter("not kept").count() == 2
    verified = [p for p in plans if p.count("codes#") and "MapInArrow" in p]
    assert len(verified) == 3 and all("LeftSemi, BuildRight" in p for p in verified)
    pairs, codes = given[0]
    named = {x for r in pairs.collect() for x in (r.a, r.b)}
    read = {r.row for r in near_dedup._needed(codes, pairs).collect()}
    assert named <= read and len(named) == 4 and len(read) <= 6


def test_signature_tells_long_texts_apart():
    """Texts of 700 words of which 110 differ are told apart by parities, before their words are read."""
    pick = random.Random(6)
    words = [f"w{pick.randrange(10 ** 6)}" for _ in range(700)]
    other = words[:590] + [f"v{pick.randrange(10 ** 6)}" for _ in range(110)]
    one, two = (near_dedup.omh.kmers(near_dedup.omh.word_codes(" ".join(w))) for w in (words, other))
    differ = sum((a ^ b).bit_count() for a, b in zip(
        *(near_dedup._signature(g).view(np.uint64).tolist() for g in (one, two))))
    assert near_dedup.omh.aligned(one, two) < 0.8
    assert len(np.setxor1d(one, two)) >= differ > int((len(one) + len(two)) * 0.2 / 1.8)


def test_short_near_duplicates(spark):
    rows = []
    for group in range(40):
        words = [f"g{group}w{i}" for i in range(10)]
        long = words[:9 + group % 2]
        rows += [" ".join(long), " ".join(long[1:] if group % 4 < 2 else long[:-1])]
    rows += [" ".join(f"x{i}" for i in range(n)) for n in (6, 7, 3, 4)]  # too far apart
    got = {r.doc_id: r.class_id for r in near_duplicates(
        spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if (brute.ordered_similarity(rows[i], rows[j]) or 0) >= 0.8]
    assert len(linked) == 40 and [got[i] for i in range(len(rows))] == brute.classes(rows, linked)


def test_main_text():
    pages = labelled_pages(14)[len(labelled_pages()):]  # rounds that did not train
    read = [html_text.Page(p) for p in pages]
    p, _ = html_text.marginals(*html_text._features(read), *html_text.trained())
    marked = np.array([m for page in read for m in page.marked])
    assert ((p >= 0.5) == marked).mean() > 0.98


def test_layouts_left_out():
    """The content of every layout is found by potentials that never saw the layout."""
    layouts, rounds = len(labelled_pages(1)), 10
    every = labelled_pages(rounds)
    kept = taken = marked = 0
    for number in range(layouts):
        mine = [html_text.Page(p) for p in every[number::layouts]]
        potentials = html_text.fit([p for n, p in enumerate(every) if n % layouts != number], 120)
        p, _ = html_text.marginals(*html_text._features(mine), *potentials)
        label = np.array([m for page in mine for m in page.marked])
        size = np.array([c for page in mine for c in page.chars])
        found = p >= 0.5
        assert size[found & label].sum() >= 0.97 * size[label].sum()
        kept, taken, marked = kept + size[found & label].sum(), taken + size[found].sum(), marked + size[label].sum()
    assert kept >= 0.99 * marked and kept >= 0.95 * taken


def test_inline_elements_and_short_articles():
    read = lambda body: html_text.main_texts([f"<html><body>{body}</body></html>"])[0]
    more = "<p>Another paragraph of the article. It has two sentences.</p>"
    menu = "<nav><ul><li><a href='/'>Home</a></li><li><a href='/b'>News</a></li></ul></nav>"
    for name in ('span class="more"', 'code class="language-text"', 'b class="text"', "button", "em"):
        assert read(f"{menu}<article><p>Hello there, <{name}>big world</{name.split()[0]}> and more of it.</p>{more}</article>") == (
            "Hello there, big world and more of it.\n\nAnother paragraph of the article. It has two sentences.")
    assert "The sum a+b is known." in read(
        f"<article><h1>T</h1><p>The sum <math><mi>a</mi><mo>+</mo><mi>b</mi></math> is known. We use it.</p>{more}</article>")
    assert read(f"{menu}<article><p>One short paragraph.</p></article><footer>&copy; Me</footer>") == "One short paragraph."
    assert read("<main><p>Just one line of text.</p></main>") == "Just one line of text."
    blocks = lambda s: [t for _, t in html_text.Page(s).runs]
    assert blocks('<p>a <span class="x more">b <div>c</div> d</span> e</p>') == ["a b", "c", "d e"]
    assert blocks('<p>a <span class="more">b<p>c</span>d') == ["a b", "cd"]


def test_deep_pages_take_linear_time():
    import time

    seconds = []
    for n in (4000, 32_000):
        start = time.perf_counter()
        html_text.Page('<div><span class="more">' * n + "</span></em></section>" * n + "<p>x" * n)
        seconds.append(time.perf_counter() - start)
    assert seconds[1] < 32 * seconds[0] + 0.5


def test_marginals_by_enumeration():
    pick = np.random.default_rng(0)
    page = html_text.Page("<body><div>a<p>b</p><ul><li>c</li></ul></div><p>d</p></body>")
    forest = html_text._features([page])
    unary, pair = pick.normal(size=html_text._FEATURES), pick.normal(size=(html_text._KIND_COUNT, 2, 2))
    got, _ = html_text.marginals(*forest, unary, pair)
    parent, _, kind, active, _ = forest
    n = len(parent)
    total = np.zeros(n + 1)
    for state in range(2 ** n):
        y = [state >> i & 1 for i in range(n)]
        weight = np.exp(sum(y[i] * unary[active[i]].sum() + (pair[kind[i], y[parent[i]], y[i]] if parent[i] >= 0 else 0) for i in range(n)))
        total += weight * np.array([*y, 1])
    assert np.allclose(got, total[:n] / total[n])


def test_pages_of_the_table(spark):
    rows = spark.read.parquet(f"{FOLDER}/pages.parquet").collect()
    import html

    for r, got in zip(rows, html_text.main_texts([r.html for r in rows])):
        inside = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1]
        inside = re.sub(r"<(?:[^>]*>|[^>]*\Z)", "\0", re.sub(r"</?b>|<br>", " ", inside))
        blocks = [" ".join(html.unescape(x).split()) for x in inside.split("\0")]
        assert got == "\n\n".join(x for x in blocks if x)


def test_page_reader():
    read = lambda s: [t for _, t in html_text.Page(s).runs]
    assert read("<p>a&amp;b &lt;c&gt;<br>d<p>e") == ["a&b <c> d", "e"]
    assert read("x<script>var a='<p>no</p>'</script>y<!-- <p>no</p> -->z") == ["xyz"]
    assert read("<ul><li>a<li>b</ul>1 < 2 &copy; <b") == ["a", "b", "1 < 2 ©"]
    assert read("") == [] and read("plain") == ["plain"]


def test_merge_dropout(texts):
    from sentencepiece import SentencePieceProcessor

    path = tokenizer_path("piece_bpe_32k.model")
    own, some = SentencePieceProcessor(model_file=path), [*list(texts.values())[:150], *ODD]
    plain, varied, again = (merge_dropout.DropoutCoder(path, 17, r) for r in (0.0, 0.1, 0.1))
    different = 0
    for n, text in enumerate(some):
        if "▁" not in text:
            assert np.frombuffer(plain.encode(text, n), "<u4").tolist() == own.encode(text)
        ids = varied.encode(text, n)
        assert varied.decode(ids) == text and plain.decode(plain.encode(text, n)) == text
        assert again.encode(text, n) == ids
        different += ids != plain.encode(text, n)
    assert different > 140
    assert varied.encode(some[0], 1) != varied.encode(some[0], 2)
    other = merge_dropout.DropoutCoder(path, 18, 0.1)
    assert other.encode(some[0], 1) != varied.encode(some[0], 1)


def test_every_occurrence_draws_its_own_merges():
    coder = merge_dropout.DropoutCoder(tokenizer_path("piece_bpe_32k.model"), 17, 0.1)
    text = " ".join(["internationalization"] * 3000 + ["x" * 90, "a▁b", "\n"])
    units = coder._cut(text)
    splits = [coder.segment(u, int(k)) if u else ["▁"] for u, k in zip(units, coder._keys(4, len(units)))]
    assert len({tuple(x) for x in splits[:3000]}) > 20
    # what is remembered changes nothing
    want = b"".join(coder._ids(s) if u else coder._mark.tobytes() for u, s in zip(units, splits))
    assert coder.encode(text, 4) == want == coder.encode_all(["", "b c", text], [1, 2, 4])[2]


def test_skipped_share():
    coder = merge_dropout.DropoutCoder(tokenizer_path("piece_bpe_32k.model"), 5, 0.25)
    skipped = [coder._skipped(v, at, f"p{n}") for v in range(8) for at in range(20) for n in range(20)]
    assert 0.2 < np.mean(skipped) < 0.3
