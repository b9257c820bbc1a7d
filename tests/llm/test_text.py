"""Token counts, segmentations, packing, personal data and pages against the libraries and brute force."""
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from barloom.llm import packing, pages, personal, segments, tokens

BYTES, WORDS, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


def test_prefix_counts_equal_the_library():
    from tokenizers import Tokenizer

    library, own, r = Tokenizer.from_file(BYTES), tokens.PrefixCounter(BYTES), random.Random(3)
    bits = list("aabcdeerstxy  \n\t'é日🙂$%&0123.,-") + ["'re", "'ll", " \n", "<|endoftext|>", "<|endof", "the", "  ", "\x1c", " "]
    for _ in range(250):
        text = "".join(r.choice(bits) for _ in range(r.randint(0, 18)))
        changes = own.changes(text)
        assert len(changes) == len(text)
        for k in range(len(text) + 1):
            assert tokens.tokens_of_prefix(changes, k) == len(library.encode(text[:k], add_special_tokens=False).ids), text[:k]
        fit = tokens.longest_prefix(changes, 4)
        assert tokens.tokens_of_prefix(changes, fit) <= 4 and all(tokens.tokens_of_prefix(changes, k) > 4 for k in range(fit + 1, len(text) + 1))
    text = "ab" * 30_000
    assert tokens.tokens_of_prefix(own.changes(text), len(text)) == len(library.encode(text).ids)


def test_token_query(documents, corpus, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTES)
    got = tokens.within_budget(tokens.prefix_counts(documents.withColumn("changes", F.lit(1)), BYTES), 512).select("doc_id", "n_bytes", "n_tokens", "over_limit")
    want = Counter()
    for i, text, *_ in corpus:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        want[i, len((text or "").encode()), n, n > 512] += 1
    assert Counter(map(tuple, got.collect())) == want
    assert tokens.within_budget(tokens.prefix_counts(empty, BYTES), 5).count() == 0


def test_packing(documents, corpus, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    want = Counter()
    for i, text, *_ in corpus:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            want[i, k // 2048, k, len(ids[k:k + 2048]), zlib.crc32(np.array(ids[k:k + 2048], "<u4").tobytes())] += 1
    rows = packing.packed(documents, WORDS).collect()
    assert Counter(tuple(r)[:5] for r in rows) == want
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(held) <= math.ceil(sum(r.length for r in rows) / 2048) + 1
    assert packing.packed(empty, WORDS).count() == 0


def test_best_fit_takes_the_fullest_bin():
    bins = packing.best_fit([6, 5, 4, 3, 2], 10)
    assert sorted(sorted(b) for b in bins) == [[0, 2], [1, 3, 4]]


def test_plan_is_best_fit_over_all_pieces():
    """Short texts in some tasks, long ones in others, more than any task holds: every one meets its partner."""
    n = 200_000
    assert sum(high - low for _, low, high, *_ in packing.plan({1100: n, 900: n, 48: n})) == 3 * n
    assert len({first + k for _, low, high, each, first, _ in packing.plan({1100: n, 900: n, 48: n}) for k in range(0, (high - low) // each)}) == n
    r = random.Random(6)
    for _ in range(300):
        limit = r.randint(4, 60)
        sizes = [r.randint(1, limit) for _ in range(r.randint(0, 200))]
        rooms = []
        for s in sorted(sizes, reverse=True):
            fits = [x for x in rooms if x >= s]
            if fits:
                rooms.remove(min(fits))
            rooms.append((min(fits) if fits else limit) - s)
        bins = packing.best_fit(sizes, limit)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        assert sorted(limit - sum(sizes[i] for i in b) for b in bins) == sorted(rooms)
        runs = packing.plan(Counter(sizes), limit)
        spans = sorted((first + k, at + j * s, s) for s, low, high, each, first, at in runs for k in range((high - low) // each) for j in range(each))
        assert all(b[1] == (a[1] + a[2] if a[0] == b[0] else 0) for a, b in zip(spans, spans[1:]))


def test_partners_in_other_files_meet(spark):
    """Texts of 1,100 tokens in one file and of 947 in another fill sequences together, as many files as there are."""
    long, short = "the " * 1099, "the " * 946
    docs = spark.createDataFrame([(i, long if i < 60 else short) for i in range(120)], "doc_id long, text string").repartitionByRange(12, "doc_id")
    rows = packing.packed(docs, WORDS).collect()
    assert Counter(r.length for r in rows) == {1100: 60, 947: 60}
    assert Counter(Counter(r.sequence_id for r in rows).values()) == {2: 60}
    assert Counter((r.length, r.offset) for r in rows) == {(1100, 0): 60, (947, 1100): 60}


def test_word_ids_with_odd_separators():
    from tokenizers import Tokenizer

    library, own, r = Tokenizer.from_file(WORDS), packing.word_tokenizer(WORDS), random.Random(8)
    for _ in range(300):
        text = "".join(r.choice(["a", "Bé", "́", " ", "\n", "\x1c", "\x85", " ", "<|endoftext|>", "don't", "12", "$%", "ß", "İ", "Σ"]) for _ in range(12))
        assert np.frombuffer(own([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def spans_brute(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 12 <= len(d) <= 19 and personal.luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out, key=lambda s: (s[1], personal.ORDER[s[0]]))


def test_spans_equal_the_patterns():
    r = random.Random(5)
    for _ in range(8000):
        text = "".join(r.choice("aB1234567890..@@++-- ()%é/:") for _ in range(r.randint(0, 60)))
        if r.random() < .3:
            text = text.replace("a", "4111 1111 1111 1111").replace("B", "+1 (555) 555-1234")
        assert [s for s in personal.find(text) if s[0] in personal.BASE] == spans_brute(text), text
    assert personal.find("1" * 200_000 + "." * 3) is not None


def test_added_kinds_and_masks():
    text = "IBAN DE89 3704 0044 0532 0130 00 now https://bob:pw@x.org/ a@b.co"
    assert [s[0] for s in personal.find(text)] == ["account", "login", "email", "email"]
    assert personal.masked(text) == "IBAN <ACCOUNT> now <LOGIN>/ <EMAIL>"
    assert personal.masked(None) is None and personal.masked("") == ""


def test_personal_query(documents, corpus, empty):
    got = {(r.doc_id, r.spans) for r in personal.personal_data(documents).collect()}
    assert got == {(i, personal.listed(personal.find(t))) for i, t, *_ in corpus}
    hidden = personal.mask_personal_data(documents.withColumn("_p", F.lit(1)))
    assert hidden.columns == [*documents.columns, "_p"]
    assert Counter((r.doc_id, r.text) for r in hidden.collect()) == Counter((i, personal.masked(t)) for i, t, *_ in corpus)
    assert personal.personal_data(empty).count() == 0


def test_samples_are_distinct_and_unbiased():
    """First samples follow the exact distribution; inclusion scores make the weighted samples sum to it."""
    model, text = segments.pieces_of(PIECES), "then a"
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=PIECES)

    def every(unit):
        if not unit:
            yield ()
        for n in range(1, len(unit) + 1):
            i = library.piece_to_id(unit[:n])
            if i:
                for rest in every(unit[n:]):
                    yield (i, *rest)

    exact = {s: math.exp(segments.THETA * model.weight[list(s)].sum()) for s in every("▁then▁a")}
    total = sum(exact.values())
    n = 3000
    found = segments.sample_batch(model, list(range(n)), [text] * n, 3, segments.THETA)
    first, weighted = Counter(), Counter()
    for samples in found:
        assert len({tuple(ids) for ids, *_ in samples}) == 3
        first[tuple(samples[0][0])] += 1 / n
        for ids, log_p, _, inside in samples:
            assert abs(math.exp(log_p) - exact[tuple(ids)] / total) < 1e-9 and model.decode(ids) == text
            weighted[tuple(ids)] += math.exp(log_p - inside) / n
    assert max(abs(first[s] - p / total) for s, p in exact.items()) < .04
    assert max(abs(weighted[s] - p / total) for s, p in exact.items()) < .02


def test_samples_of_any_text(documents, corpus, empty):
    rows = segments.sample_segmentations(documents, PIECES, 3)
    back = segments.decode_pieces(rows, PIECES).collect()
    texts = {(i, t or "") for i, t, *_ in corpus}
    assert {(r.doc_id, r.text) for r in back} == texts
    per = Counter(r.doc_id for r in back if r.doc_id is not None)
    assert per[71] == 1 and per[72] == 3 and per[80] == 3
    again = segments.sample_segmentations(documents.repartition(7), PIECES, 3)
    assert sorted(map(str, rows.collect())) == sorted(map(str, again.collect()))
    assert segments.segmentation_figures(empty, PIECES).count() == 0


def test_page_text():
    text = lambda h: pages.Page(h).text(set())
    assert text("<body class='has-sidebar'><div class='with-sidebar'><article class=post><header class='post-header'><h1>T &amp; x</h1></header>"
                "<p>a<br>b <i>c</i></p><div class='share'>s</div><footer>f</footer></article><section class=comments><article><p>no</p></article>"
                "</section></div><div id=cookie-notice>ck</div>") == "T & x\na b c"
    assert text("<p>one<p>two <a href=x>l</a><ul><li><a>n</a><li><a>m</a></ul><script>x='<p>'</script>tail &#233; < 5 <!-- c --> done") == "one\ntwo l\ntail é < 5 done"
    assert text("") == "" and text("<div>" * 20_000 + "deep") == "deep" and text("<p title='>'>x</p><p 'y>z") == "x\nz"


def test_tree_matching():
    tree = lambda h, shapes: pages.Tree(pages.Page(h).skeleton(), shapes)
    shapes = {}
    a, b = tree("<div><p>1</p><ul><li>x<li>y</ul><p>2</p></div>", shapes), tree("<div><ul><li>x<li>y<li>z</ul><p>3</p></div>", shapes)
    assert len(pages.match(a, b)) == 6  # root, div, ul, two items, the last paragraph
    assert len(pages.match(a, a)) == len(a.label)


def test_template_inside_articles_goes(spark):
    """A line that all pages of a host have in one place is template, wherever it stands; other hosts keep theirs."""
    page = "<body><nav>m</nav><article><h1>t{0}</h1><div class=x>Sign here</div><p>text {0} is new</p></article></body>"
    rows = [(i, f"http://a.org/{i}", page.format(i)) for i in range(24)] + [(99, "http://b.org/1", page.format(99)), (100, None, page.format(100)),
                                                                         (101, "http://a.org/n", None), (102, "http://a.org/e", "")]
    got = {r.page_id: r.text for r in pages.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert all(got[i] == f"t{i}\ntext {i} is new" for i in range(24))
    assert got[99] == "t99\nSign here\ntext 99 is new" and got[100] == "t100\nSign here\ntext 100 is new" and got[101] == got[102] == ""
    assert pages.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def extracted(spark, rows):
    return {r.page_id: r.text for r in pages.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}


def test_copies_are_no_template(spark):
    """Copies of one article on a host, whatever their scripts, count once: it is kept, and what all articles share goes."""
    page = "<script>track({0})</script><body><article><h1>t{1}</h1><div class=x>Sign here</div>{2}</article></body>"
    long = "".join(f"<p>part {k} of it</p>" for k in range(30))
    rows = [(i, f"http://a.org/1?track={i}", page.format(i, 0, long)) for i in range(300)] + [(i, f"http://a.org/{i}", page.format(i, i, f"<p>text {i}</p>")) for i in range(300, 312)]
    got = extracted(spark, rows)
    assert all(got[i] == "\n".join(["t0", *(f"part {k} of it" for k in range(30))]) for i in range(300))
    assert all(got[i] == f"t{i}\ntext {i}" for i in range(300, 312))


def test_each_layout_has_a_wrapper(spark):
    """Two layouts of a host, blank and error pages, and a notice that some pages lack."""
    page = "<body class={0}><div class=wrap>{2}<h1>t{1}</h1><p>text {1} is new</p><div class=x>Sign here</div></div></body>"
    rows = [(i, f"http://a.org/{i}", page.format(("home", "single")[i % 2], i, "<div class=y>Now open</div>" if i not in (6, 7) else "")) for i in range(60)]
    rows += [(i, f"http://a.org/{i}", "" if i % 2 else "<body><p>Error 404</p></body>") for i in range(60, 100)]
    got = extracted(spark, rows)
    assert all(got[i] == f"t{i}\ntext {i} is new" for i in range(60))
    assert all(got[i] == ("" if i % 2 else "Error 404") for i in range(60, 100))


def test_long_lists_are_matched_like_short_ones(monkeypatch):
    """One block more near the top of a long flat page shifts nothing; halving gives the mapping of the whole table."""
    tree = lambda h, shapes: pages.Tree(pages.Page(h).skeleton(), shapes)
    flat = lambda k, more: "<body>" + "".join((f"<p>{k} {i}</p>" if i % 3 else f"<div>line {i}</div>") + more * (i == 4) for i in range(1500))
    shapes = {}
    a, b = tree(flat("x", ""), shapes), tree(flat("y", "<div>extra</div><h2>z</h2>"), shapes)
    same = {a.own[i] for i, j in pages.match(a, b) if a.own[i] and a.own[i] == b.own[j]}
    assert len(same) == 500
    r = random.Random(7)
    some = lambda: "".join(r.choice(["<p>a</p>", "<p>b</p>", "<div><p>c</p></div>", "<div><p>c</p><p>d</p></div>", "<ul><li>x</ul>"]) for _ in range(r.randint(0, 14)))
    for _ in range(150):
        a, b = tree(some(), shapes), tree(some(), shapes)
        found = []
        for cells in (10 ** 6, 3):
            monkeypatch.setattr(pages, "CELLS", cells)
            found.append(pages.match(a, b))
        top = [sum(a.own[i] == b.own[j] != 0 for i, j in m if i in a.kids[0]) for m in found]
        assert len(found[0]) == len(found[1]) and top[0] == top[1]
        assert all(a.label[i] == b.label[j] for i, j in found[1])
        top = sorted(p for p in found[1] if p[0] in a.kids[0])
        assert len({j for _, j in found[1]}) == len(found[1]) and all(x[1] < y[1] for x, y in zip(top, top[1:]))


def test_links_in_running_text_stay():
    """Pages without article: headings, sentences and entries made of links are text; lists of nothing but links are menus."""
    text = lambda h: pages.Page(h).text(set())
    assert text("<body><ul><li><a>Home</a><li><a>About</a><li><a>More</a></ul><h2><a href=#x>Heading</a></h2><p>It was so.</p>"
                "<p><a>A paragraph that is a link</a></p><p>See <a>this long title of a paper</a>.</p>"
                "<ul><li><a>First paper of all</a>, 1999<li><a>Second</a></ul></body>") == (
                    "Heading\nIt was so.\nA paragraph that is a link\nSee this long title of a paper.\nFirst paper of all, 1999\nSecond")
    assert text("<div><a>One</a> | <a>Two</a></div><div>said <a>a whole long sentence of links</a></div><div><a>alone</a></div>") == "said a whole long sentence of links\nalone"
    assert text("<table><tr><td><a>m</a><td><a>n</a></table><h3><a>h</a></h3><h3><a>i</a></h3>") == "h\ni"


def test_words_that_differ_in_punctuation_are_walked_once(monkeypatch):
    from tokenizers import Tokenizer

    counter = tokens.PrefixCounter(BYTES)
    walked, inside = [], counter.inside
    monkeypatch.setattr(counter, "inside", lambda letters: walked.append(letters) or inside(letters))
    texts = [f" vellorimquast{end}" for end in (",", ".", ";", "!)", ", 7", " é,")]
    got = [tokens.tokens_of_prefix(counter.changes(t), n) for t in texts for n in range(len(t) + 1)]
    library = Tokenizer.from_file(BYTES)
    assert got == [len(library.encode(t[:n], add_special_tokens=False).ids) for t in texts for n in range(len(t) + 1)]
    assert len(walked) == len(set(walked))
