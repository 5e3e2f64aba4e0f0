"""What most pages are is put together without the libraries for what any page may be; both ways give the same."""

from __future__ import annotations

import random

import yaml
from pyspark.sql import functions as F

from leafmill.functions.render import jobs as J
from leafmill.functions.render import tree as T

#: Texts that YAML leaves as they are or puts between quotes, and others.
COMMON = ["Some page", "3-MEDIUM", "4-NOT SPECIFIED", "ASIA/CHINA/BUILDING-2/3-MEDIUM", "ASIA/_archived/x", "Straße 中文", "o12", "12", "0", "", "2024-01-31", "2024-01-31T10:20:30.123Z", "https://a.example/wiki/x?y=1&z=2", "x.drawio.png", "application/vnd.jgraph"]
ODD = ["yes", "No", "OFF", "null", "y", "~", "=", "<<", "-", "a: b", "a #b", "a:", "'", '"', "a ", " a", "a\n", "a\tb", "\x85", "﻿", "012", "0x1F", "0b1", "1_000", "1.5", "1e+3", "12:30", "12:30:45.1", ".inf", "---", "...", "@a", "`", "g " * 60 + "g", "x" * 300, "2001-12-14 21:59:43", "https://x.y/:", "https://x: y", "😀"]


def dumped(block: dict) -> str:
    return yaml.safe_dump(block, sort_keys=False, allow_unicode=True, default_flow_style=False)


def test_common_texts_need_no_library(spark):
    got = {r.v: r.y for r in spark.createDataFrame([(v,) for v in COMMON + ODD], "v string").select("v", J._yaml(F.col("v")).alias("y")).collect()}
    assert all(got[v] is not None for v in COMMON)
    assert not [(v, y) for v, y in got.items() if y is not None and f"last_modified: {y}\n" != dumped({"last_modified": v})]


def test_frontmatter_equals_the_librarys(spark):
    rnd, names = random.Random(4), ["title", "page_id", "space_key", "path", "url", "last_modified"]
    rows, wanted = [], {}
    for k in range(300):
        texts = [rnd.choice(ODD if rnd.random() < 0.1 else COMMON) for _ in names]
        files = [(rnd.choice(ODD if rnd.random() < 0.2 else COMMON), "image/png", 1 << 40) for _ in range(k % 3)]
        rows.append((k, *texts, k, "archived" if k % 2 else "current", files))
        block = dict(zip(names, texts, strict=True)) | {"version": k} | ({"status": "archived"} if k % 2 else {})
        wanted[k] = "---\n" + dumped(block | ({"attachments": [{"name": a, "type": b, "size": c} for a, b, c in files]} if files else {})) + "---\n\n"
    pages = spark.createDataFrame(rows, f"k int, {', '.join(f'{n} string' for n in names)}, version int, status string, attachments array<struct<name:string,type:string,size:bigint>>")
    assert {r.k: r.frontmatter for r in J.frontmatter(pages).collect()} == wanted


def test_plain_pages_need_no_parser():
    assert T._read_plain('<p>by <ri:user ri:account-id="u1"/> on o1</p>') is not None
    parts = ["<p>", "</p>", "<li>", "</li>", "<br/>", "<br />", "<hr>", "a > b", "\n", '"', '<a href="x y" class="é">', "</a>", "<td>", "<ac:link>", "</ac:link>", "<p/>", "</zz>", '<a b="1" b="2">']
    odd = ["<P>", "<a b=c>", "<a b>", "&amp;", "&", "<", "<!--x-->", "<![CDATA[y<]]>", "<script>", "</script>", "<title>", "</p >", '<a b="1"c="2">']
    rnd, plain = random.Random(5), 0
    for k in range(5000):
        html = "".join(rnd.choice(odd if k % 2 and rnd.random() < 0.1 else parts) for _ in range(rnd.randint(0, 12)))
        reader = T._Reader()
        reader.feed(html)
        reader.close()
        made = T._read_plain(html)
        plain += made is not None
        assert made is None or made == reader.open[0], html
    assert plain > 2500
