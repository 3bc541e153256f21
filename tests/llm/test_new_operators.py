"""Structure repair, main text of pages and the source audit: against brute force and on awkward rows."""

import collections
import hashlib
import heapq
import html
import os
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import html_extract, source_audit, turn_repair

# ---------------------------------------------------------------- structure repair


def cheapest(path):
    """All edits in order of cost and then of their initials; the first that ends well."""
    heap = [(0, "", 0, 0)]
    while heap:
        cost, edits, i, state = heapq.heappop(heap)
        if i == len(path) and state in (0, 3):
            return edits, cost
        after = 3 if state == 2 else 2
        if edits[-3:] != "III":
            heapq.heappush(heap, (cost + 2, edits + "I", i, after))
        if i < len(path):
            role, fault = divmod(ord(path[i]) - ord("a"), 4)
            heapq.heappush(heap, (cost + 3, edits + "D", i + 1, state))
            if fault in (0, 3):
                stays = cost + (fault == 3)
                if (role, state) == (0, 0):
                    heapq.heappush(heap, (stays, edits + "K", i + 1, 1))
                if role in (1, 2) and role + 1 == after:
                    heapq.heappush(heap, (stays, edits + "K", i + 1, after))
                heapq.heappush(heap, (stays + 2, edits + "R", i + 1, after))


def test_trie_gives_the_cheapest_edits():
    rng = random.Random(3)
    paths = {"".join(rng.choice("abcdefghijklmnop" if rng.random() < 0.5 else "aehei") for _ in range(rng.randint(0, 6))) for _ in range(1500)}
    trie = turn_repair.Trie()
    for path in sorted(paths):
        assert trie.answer(path) == cheapest(path), path
    # order and company don't matter
    some = rng.sample(sorted(paths), 50)
    assert [turn_repair.Trie().answer(p) for p in some] == [trie.answer(p) for p in some]
    assert len(trie.layers) < 1000
    edits, cost = trie.answer("ei" * 50_000 + "e")
    assert edits == "K" * 100_001 + "I" and cost == 2


def naive_repair(rows):
    """rows: (turn, role, text) of one conversation, damaged."""
    rows = [(t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows]
    mark = lambda r: hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), mark(r)))
    seen, path, counts = set(), "", collections.Counter()
    for _, role, text in rows:
        last = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
        fault = 1 if not last else 2 if (role, text) in seen else 3 if last not in ".!?" else 0
        seen.add((role, text))
        counts[fault] += 1
        path += chr(ord("a") + 4 * ("sua".find(role[:1]) if role[:1] in ("s", "u", "a") else 3) + fault)
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    turns = {t for t, _, _ in rows if t is not None}
    audit, cost = cheapest(path)
    out, state, i = [], "", 0
    for e in audit:
        role, text = ("", "") if e == "I" else rows[i][1:]
        i += e != "I"
        if e == "D":
            continue
        state = role[0] if e == "K" else "a" if state == "u" else "u"
        out.append(f"{role if e == 'K' else {'u': 'user', 'a': 'assistant'}[state]}:{text}")
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, counts[1], counts[2], counts[3], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def conversations():
    rng = random.Random(8)
    out = []
    for c in [None, *range(60)]:
        for t in range(rng.randint(1, 7)):
            role = rng.choice(["user", "assistant", "system", "assistant", "user", "tool", "User", "", None])
            text = rng.choice(["Yes.", "No!", "what", "Why? ", "  ", "", None, "same.", "é.\n", "a . b"])
            out.append((c, rng.choice([t, t, t, t + 3, None]) if rng.random() < 0.4 else t, role, text))
    return out + out[5:15] + [(900, None, None, None)] * 3 + [(901, 5, "user", "x" * 50_000 + ".")]


def digested(spark, rows, of=None):
    planned = turn_repair.plans(rows, of).cache()
    found = turn_repair.digests(turn_repair.repaired(rows, planned)).withColumnRenamed("conv_id", "id")
    out = planned.join(found, F.col("conv_id").eqNullSafe(F.col("id")), "left").collect()
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.sha256 or hashlib.sha256(b"").hexdigest()) for r in out}


def test_repair_is_brute_force(spark):
    data = conversations()
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    by = collections.defaultdict(list)
    for c, *r in data:
        by[c].append(tuple(r))
    clash = df.withColumn("audit", F.lit("x")).withColumn("signature", F.lit(1)).withColumn("mark", F.lit(2))
    assert digested(spark, clash) == {c: naive_repair(r) for c, r in by.items()}
    some = spark.createDataFrame([(7777,), (7777,), (1,)], "conv_id long")
    assert digested(spark, df.limit(0), some) == {7777: naive_repair([]), 1: naive_repair([])}
    assert digested(spark, df.limit(0)) == {}


def test_repaired_rows_alternate(spark):
    df = spark.createDataFrame(conversations(), "conv_id long, turn long, role string, text string")
    planned = turn_repair.plans(df).cache()
    got = collections.defaultdict(list)
    for r in turn_repair.repaired(df, planned).collect():
        got[r.conv_id].append((r.position, r.role[0], r.edit))
    for r in planned.collect():
        rows = sorted(got[r.conv_id])
        assert [p for p, _, _ in rows] == list(range(len(rows)))
        assert re.fullmatch("(s?(ua)+)?", "".join(x for _, x, _ in rows))
        assert "".join(e for _, _, e in rows) == r.audit.replace("D", "")


def test_damage(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", "One. Two! Three?") for c in range(40) for t in range(4)] + [(None, None, None, None)]
    got = collections.Counter(map(tuple, turn_repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()))
    want = collections.Counter()
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = r or " ", x or " "
        row = {0: None, 1: (c, t, r, ""), 2: (c, t, r, re.sub("[.!?]", "", x)), 4: (c, t, "user", x)}.get(kind, (c, t, r, x))
        if row:
            want[row] += 2 if kind == 3 else 1
    assert got == want


def test_repair_takes_text_ids_and_hot_conversations(spark):
    rows = [("big", i, "user" if i % 2 == 0 else "assistant", f"text {i}.") for i in range(5000)] + [("x", 1, "user", "Same.")] * 300
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    got = digested(spark, df)
    assert got["big"][5:7] == (0, "K" * 5000)
    assert got["x"][2] == 299 and got["x"][6] in ("K" + "D" * 299 + "I", "D" * 299 + "KI", "KI" + "D" * 299, "K" + "D" * 299 + "I") and got["x"][5] == 299 * 3 + 2


# ---------------------------------------------------------------- main text


@pytest.fixture(scope="module")
def model():
    return html_extract.fit(html_extract.layouts())


def test_layouts_are_read_back(model):
    pages = list(html_extract.layouts())
    assert sum(html_extract.main_text(s, model) != t for s, t in pages) == 0
    # parts and main elements that were left out when the model was fitted
    held = html_extract.fit(p for i, p in enumerate(pages) if i % 5)
    wrong = sum(html_extract.main_text(s, held) != t for i, (s, t) in enumerate(pages) if i % 5 == 0)
    assert wrong <= 0.03 * len(pages) / 5


#: Pages unlike the layouts, and their main texts.
PAGES = [
    ('<body><div class="hdr"><a href=/>Home</a> <a href=/a>About us</a></div><div class="cookie-consent"><p>We use cookies to make it better for all.</p><button>OK</button></div><div class="c1"><div class="c2"><h1>Title here</h1><p>First paragraph, long enough &amp; more.</p><aside class="pullout"><p>Read more of our stories today</p></aside><p>Second one <i>it</i>al<b>ic</b>&nbsp;x.</p><ul><li>one</li><li>two <a href=x>three</a></li></ul></div></div><div id="comments"><h3>Comments</h3><div class="comment"><p>great article, I do like it a lot, very much so</p></div></div><footer><p>Copyright me</p></footer></body>', "Title here First paragraph, long enough & more. Second one italic x. one two three"),
    ('<body><header><h1>Site name</h1><nav><a>x</a></nav></header><main><article><h1>Short</h1><div class="ad-unit">buy this now and get one more for free if you hurry up until the end of this week or the next</div><p>Text.</p><h3>Sub</h3><h4>Subsub</h4><p><a href="x">A linked paragraph alone</a></p><form><label>Mail</label><input><button>Go</button></form><p>End.</p></article><section class="user-comments"><article><p>I am a reader and I comment here at some length, more than the text.</p></article></section></main><div class="newsletter-signup"><p>Sign up for it</p></div></body>', "Short Text. Sub Subsub A linked paragraph alone End."),
    ("just plain text, no tags &lt;b&gt;", "just plain text, no tags <b>"),
    ("", ""),
    ("<p>one<p>two", "one two"),
    ("<nav><a>x</a></nav>", ""),
    ('<div role="main"><p>a b c d</p></div><div role="complementary"><p>zz yy xx ww</p></div>', "a b c d"),
    ('<p>5 < 6 and 7 > 3 <b title="a > b">x</b><!-- c > --> y</p><script>if (a<b) document.write("<p>no</p>")</script>', "5 < 6 and 7 > 3 x y"),
    ('<article><p>One</p><div class="advertisement"><p>Buy now</p></div><div class="sidebar"><p>side stuff</p></div><div class="notice">Notice of things</div><p>Two</p></article><div class="comments"><p>hi there you all</p></div>', "One Two"),
    ('<article><h1>H</h1><p>One</p><aside>x y z</aside><section class="reader-comments"><h2>Comments</h2><p>First!</p></section></article>', "H One"),
    ("<ARTICLE><P>upper case &eacute;&#233;&#xe9;&copy &unknown; &am</P></ARTICLE><SCRIPT>never closed <p>x</p>", "upper case ééé© &unknown; &am"),
    ("<article><ul><li>a<li>b</ul></div></span><table><tr><td>c<td>d<tr><td>e</table><p>f<br>g<p>h</article>", "a b c d e f g h"),
    ('<article><p>x</p></article><div style="display: none"><p>hidden words are not read</p></div><p hidden>nor these</p>', "x"),
]


@pytest.mark.parametrize(("source", "text"), PAGES)
def test_pages(model, source, text):
    assert html_extract.main_text(source, model) == text


@pytest.mark.parametrize("part", html_extract.ASIDE)
def test_parts_are_left_out_wherever_they_stand(model, part):
    inner = ["w x y z " * 5] + ([] if part[0] in "ps" and part[:3] != "sec" else ["<p>" + "w x y z " * 5 + "</p>", "<ul><li><a>w</a></li></ul>"])
    for x in inner:
        e = html_extract._element(part, x)
        for page in (f"<body>{e}<article><h1>A b</h1><p>c d e f</p></article>{e}</body>", f"<body><article><h1>A b</h1>{e}<p>c d e f</p></article></body>", f"<body><div class=k><h1>A b</h1>{e}<p>c d e f</p></div></body>"):
            assert html_extract.main_text(page, model) == "A b c d e f"


def best_run(scores):
    """The largest sum of neighbours, by trying all."""
    return max([0.0, *(sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1))])


def test_scan_finds_the_best_run():
    """With scores of one for words in ``b`` and of minus one to minus three for tags, against all runs."""
    rng = random.Random(2)
    tags = {"p": -1.0, "div": -2.0, "b": -3.0}
    m = html_extract.Model({}, 1.0, tags, -1.0)
    for _ in range(200):
        source = "".join(rng.choice(["w ", "w w ", "w w w ", "<p>", "<div>", "</div>", "<b>", "</b>"]) for _ in range(rng.randint(1, 14)))
        items = html_extract.parse(source, m).items
        scores = [x.words if isinstance(x, html_extract.Piece) else tags[x] for x in items]
        kept = html_extract.main_text(source, m).split()
        best = best_run(scores)
        runs = [sum(x.words for x in items[a:b] if not isinstance(x, str)) for a in range(len(items)) for b in range(a, len(items) + 1) if abs(sum(scores[a:b]) - best) < 1e-9]
        assert len(kept) in runs


def test_markup_takes_linear_time(model):
    for junk in ("<a " * 200_000, '<a ="' * 100_000, "<div>" * 100_000 + "x", "<!--" * 100_000, "&" * 300_000, "</p>" * 100_000, "<script>" * 50_000, "<p x='" * 50_000 + ">", "<b><i>" * 50_000 + "t"):
        html_extract.main_text(junk, model)
    assert html_extract.main_text("<article><p>" + "word " * 400_000 + "</article>", model) == " ".join(["word"] * 400_000)


def test_extract_table(spark, model):
    rows = [(1, "u", "<article><p>a</p></article>"), (1, "u", "<article><p>a</p></article>"), (2, None, None), (None, "v", ""), (3, "w", "<p>x" * 50_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("__main_text", F.lit(7)).withColumn("a.b", F.lit(8))
    got = html_extract.extract(df, model)
    assert got.columns == ["page_id", "url", "__main_text", "a.b", "__main_text_"]
    assert sorted((r[0] or 0, len(r["__main_text_"]), r["__main_text"], r["a.b"]) for r in got.collect()) == [(0, 0, 7, 8), (1, 1, 7, 8), (1, 1, 7, 8), (2, 0, 7, 8), (3, 99_999, 7, 8)]
    assert html_extract.extract(df.limit(0), model).count() == 0


def test_labelled_pages_teach(spark):
    """A layout whose names the rule doesn't know is learned from pages with known texts."""
    rng = random.Random(4)
    say = lambda n: " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))
    texts = {i: say(40) + "\n" + say(30) for i in range(80)}
    page = lambda t: f'<body><div class="qq"><p>{say(80)}</p></div><div class="zz">' + "".join(f"<p>{x}</p>" for x in t.split("\n")) + f'</div><div class="qq"><p>{say(60)}</p></div></body>'
    pages = spark.createDataFrame([(i, page(t)) for i, t in texts.items()] + [(500, "<p>no text known</p>"), (None, "<p>x</p>"), (7, None)], "k long, html string")
    docs = spark.createDataFrame([*texts.items(), (7, texts[7]), (900, "far"), (None, "none")], "doc_id long, text string")
    known = html_extract.labelled(pages, "k", docs, "doc_id")
    assert len(known) == 80
    model = html_extract.fit([*html_extract.layouts(), *known])
    fresh = say(50) + "\n" + say(9)
    assert html_extract.main_text(page(fresh), model) == " ".join(fresh.split())
    assert html_extract.labelled(pages.limit(0), "k", docs, "doc_id") == []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables here")
def test_whole_pages_table(spark):
    """The query against the article elements of the table, cut out by a pattern."""
    from tessera.llm import queries

    def article(source):
        inner = re.search("<article>(.*?)</article>", source, re.S)[1].replace("<b>", "").replace("</b>", "")
        return " ".join(html.unescape(re.sub("<[^>]*>", " ", inner)).split())

    rows = queries.op12_html_extract(spark, "/root/testdata/sf0.01").join(queries.read(spark, "/root/testdata/sf0.01", "pages").select("page_id", "html"), "page_id").collect()
    assert len(rows) == 250 and all(r.text == article(r.html) and r.n_chars == len(r.text) for r in rows)


# ---------------------------------------------------------------- source audit


def naive_audit(docs, least=3, top=200):
    words = [(l or "", s or "", re.findall(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").encode().lower())) for l, s, t in docs]
    out = set()
    for lang in {l for l, _, _ in words}:
        df = collections.Counter(w for l, _, ws in words if l == lang for w in set(ws))
        kept = sorted(w for w in df if df[w] >= least)
        groups = {s: collections.Counter() for l, s, _ in words if l == lang}
        for l, s, ws in words:
            if l == lang:
                groups[s].update(w for w in ws if df[w] >= least)
        share = lambda c, w: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept))
        whole = sum(groups.values(), collections.Counter())
        for s, c in groups.items():
            f = lambda p, q: (p - q) ** 2 // q
            pairs = [(sum(f(share(c, w), share(d, w)) for w in kept), o) for o, d in groups.items() if o != s]
            terms = [(f(share(c, w), share(whole, w)), w.decode()) for w in kept if c[w] and share(c, w) > share(whole, w)]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.add((lang, s, part, item, value, rank))
    return out


def audit_rows(seed=1, n=150):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("k", "é", "\U0001f600z", "￮q") for b in "abcdefghij"]
    rows = [(rng.choice(["en", "en", "de", "", None]), rng.choice(["hot", "hot", "s1", "s2", "", None]), " 1 ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 30)))) for _ in range(n)]
    rows += [("en", "void", None), ("en", "void2", "123 !"), ("xx", "a", "one two"), ("xx", "b", ""), ("yy", "only", "z z z"), ("en", "s1", "Common COMMON cOmmonİ " * 5000), ("q", "a", "tie tie2"), ("q", "b", "tie tie2"), ("q", "c", "tie2 tie")]
    return rows + rows[3:9]


def test_audit_is_brute_force(spark):
    rows = audit_rows()
    df = spark.createDataFrame(rows, "lang string, source string, text string").withColumn("term", F.lit(1)).withColumn("rank", F.lit("x")).withColumn("item", F.lit(2))
    got = source_audit.audit(df.repartition(5))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    rows_ = list(map(tuple, got.collect()))
    assert len(rows_) == len(set(rows_)) and set(rows_) == naive_audit(rows)
    assert source_audit.audit(df.limit(0)).count() == 0


def test_audit_in_small_slices_and_chunks(spark, monkeypatch):
    rows = audit_rows(2, 200)
    monkeypatch.setattr(source_audit, "CHUNK_ROWS", 7)
    monkeypatch.setattr(source_audit, "SPAN", 500)
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    assert set(map(tuple, source_audit.audit(df, top=3).collect())) == naive_audit(rows, top=3)
    monkeypatch.setattr(source_audit, "CELLS", 4)
    got = source_audit.audit(df, 2, 5)
    assert set(map(tuple, got.collect())) == naive_audit(rows, 2, 5)


def test_shares_are_exact():
    import numpy as np

    rng = random.Random(6)
    for _ in range(300):
        total = rng.choice([rng.randint(1, 50), rng.randint(1, 10**12), rng.randint(1, 9 * 10**15)])
        count = rng.randint(0, total - 1)
        assert source_audit.shares(np.array([count]), np.array([total]))[0] == 1 + 10**9 * (count + 1) // total
