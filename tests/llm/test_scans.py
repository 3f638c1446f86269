"""Secret scan, license scan and HTML extraction against plain versions and literal cases."""

import random
import re
import time

import oracle
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skywharf.llm import html_text, licenses, secret_scan

SCANNER = secret_scan.Scanner()
PLAIN = [("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 12, 2), ("access", "AKIA[A-Z0-9]+", 18, 0), ("hex", "[0-9a-f]+", 16, 0)]
BITS = ["token", "Secret", "PASSWORD", "passwd", "api_key", "apikey", " = ", ":", "=", '"', "'", "  ", "AKIA", "ABCDEFGHIJKLMN", "0123456789abcdef", "deadbeef", " ", "é", "漢", "abc", "xyz-/+", "\n", "ghp_", "eyJ"]


def plain(text):
    found = [(m.start(), k, m.end()) for k, (_, p, least, g) in enumerate(PLAIN) for m in re.finditer(p, text) if len(m[g]) >= least]
    return [(PLAIN[k][0], a, b) for a, k, b in sorted(found)]


def base(text):
    return [s for s in SCANNER.spans(text) if s[0] in ("assign", "access", "hex")]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(BITS), max_size=14).map("".join))
def test_base_spans(text):
    assert base(text) == plain(text)


def test_base_spans_of_given_documents(spark):
    for row in spark.read.parquet(f"{oracle.DATA}/sf0.01/documents.parquet").collect():
        assert base(row["text"]) == plain(row["text"])


def test_every_rule_agrees_with_its_expression():
    rnd = random.Random(5)
    bits = ["ASIA", "ghp_", "glpat-", "xoxb-", "AIza", "sk_live_", "npm_", "eyJ", ".", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "Authorization: Bearer ", "https://", "git://", "user", ":", "pw1", "@", "A" * 20, "b7" * 10, "_", "-", " "]
    for _ in range(3000):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 10)))
        got = SCANNER.spans(text)
        for rule in secret_scan.ISSUED:
            expected = []
            for m in re.finditer(rule.head + f"(?P<run>{rule.run})", text):
                if m.end() - (m.start("run") if rule.head else m.start()) >= rule.least:
                    expected.append((m.start(), m.end()))
            assert [(a, b) for k, a, b in got if k == rule.kind] == expected, (rule, text)


def test_combined_automaton_is_minimal_and_small():
    net = SCANNER.combined
    states = len(net.moves) // net.width
    assert states < 2000 and net.accepting < len(net.moves)
    tiny = secret_scan.compile_rules(["ab|cb"], anywhere=False)
    assert len(tiny.moves) // tiny.width == 4  # dead, start, after a or c, accepting


PAGES = [
    (None, ""), ("", ""), ("plain  text", "plain text"), ("<p>a<b>c<p>d</b>e", "ac de"), ("<article></article>", ""), ("a < b &amp; c", "a < b & c"),
    ("<title>T</title><nav>menu</nav><article><h1>Head</h1><p>One &lt;b&gt;, two&#33;<br>x</p><p>Three</p><div class='ad'>Buy</div></article><footer>f</footer>", "Head One <b>, two! x Three"),
    ("<div id=wrap><header>H</header><div class='sidebar'><p>Side, long, text, here</p></div><div class='post'><h2>T</h2><p>First, with, commas.</p><form><p>Mail</p></form><p>Second<p>Third<ul><li>one<li>two</ul></div>"
     "<section id='comments'><p>nice, very, very long, comment, with commas</p></section></div>", "T First, with, commas. Second Third one two"),
    ("<article><p>in</p><script>var x='</p>';</script><style>p{}</style><!-- <p>no</p> --><p style='display: none'>hid</p><p>out</article>", "in out"),
    ("<article><p>" + "long, " * 50_000 + "</p></article>", ("long, " * 50_000).strip()),
    ("<article><p>a</p><svg width=9 viewBox='0 0 1 1'/><p>b</p><math/><p>c</p><svg><title>no</title></svg><p>d</p></article>", "a b c d"),
    ("<article><p>a<noscript>b</p><p>c</p></article>", "ab c"), ("<article><p>a</p><template><p>b</p></article>", "a b"), ("<article><p>a</p><script>b</article>", "a"),
    ("<body><div><p>One, two, three, four.</p></div><h4>H</h4><ul><li>first<li>second</ul><blockquote>Quote</blockquote><table><tr><td>cell</table><ul><li><a href=x>elsewhere</a></ul></body>",
     "One, two, three, four. H first second Quote cell"),
    ("<ul><li>a<ul><li>b<li>c</ul><li>d</ul></i></b></span>", "a b c d"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"), ("<article><p>a</p></article><article><p>b</p></article>", "a b"),
]


@pytest.mark.parametrize("page,text", PAGES)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize("page", ["<p>" + "<i>" * 30_000 + "x" + "</b>" * 30_000, "<b>" * 30_000 + "<li>x" * 30_000, "<i>" * 30_000 + "x" + "</i>" * 30_000, "<div>" * 30_000 + "x" + "</i>" * 30_000])
def test_long_pages_take_time_by_their_length(page):
    started = time.time()
    assert html_text.main_text(page).replace(" ", "").strip("x") == "" and time.time() - started < 10


def test_main_text_of_given_pages(spark):
    for row in html_text.extract(spark.read.parquet(f"{oracle.DATA}/sf0.01/pages.parquet")).join(spark.read.parquet(f"{oracle.DATA}/sf0.01/pages.parquet").select("page_id", "html"), "page_id").collect():
        import html

        article = row["html"][row["html"].index("<article>") : row["html"].index("</article>")]
        parts = re.split(r"</?(?:article|h1|p)>", re.sub(r"</?b>", "", article.replace("<br>", " ")))
        expected = " ".join(x for x in (re.sub(r"\s+", " ", html.unescape(p)).strip() for p in parts) if x)
        assert row["text"] == expected and row["n_chars"] == len(expected)


LICENSES = [
    ("Licensed under the Apache License, Version 2.0.", "apache", "apache,apache-2.0"), ("under the GNU General Public License, version 3 or later", "gpl", "gpl,gpl-3-or-later"),
    ("Released under the MIT License", "mit", "mit"), ("CC BY-NC 4.0", "cc-by", "cc-by,cc-by-nc-4.0"), ("GNU Lesser General Public License v2.1", "", "lgpl-2.1"),
    ("SPDX-License-Identifier: BSD-3-Clause", "", "bsd-3-clause"), ("nothing to see", "", ""), ("MIT licenses", "", "mit"), ("mit\nLICENSE mit-license", "mit", "mit"), ("", "", ""),
]


def test_licenses(spark):
    rows = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(LICENSES)], "doc_id long, text string")).collect()}
    for k, (text, held, labels) in enumerate(LICENSES):
        assert (rows[k]["base_labels"], rows[k]["labels"]) == (held, labels), text
    assert (rows[8]["n_base"], rows[8]["first_word"], rows[8]["last_word"], rows[8]["n_words"]) == (2, 0, 2, 4)
    assert rows[6]["first_word"] is None and rows[6]["score"] == 0 and all(0 <= r["score"] <= 1 for r in rows.values())
    assert len(licenses.RULES) > 300 and len({r.keyword for r in licenses.RULES}) > 50
