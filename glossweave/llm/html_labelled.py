"""A small labelled table of text blocks: made-up pages whose elements say whether they are the article's text.

A number in braces stands for so many words. ``data-label`` is inherited, and is read for training only. The pages differ in what they tell: some name their
parts by elements, some by classes, some by nothing but the lengths of texts and the links in them; some have paragraphs of one word, and notices
longer than these.
"""

from __future__ import annotations

import random
import re

from glossweave.llm.html_blocks import Block, blocks

#: How often each page stands in the table, each time with other lengths around the stated ones.
TIMES = 3

_PAGES = (
    # parts by elements, short and long paragraphs
    '<nav><ul><li><a href="/a">{1}</a></li><li><a href="/b">{2}</a></li><li><a>{1}</a></li></ul></nav><div class="ad">{12}</div><article data-label="keep"><h1>{8}</h1><p>{60}</p><p>{1}</p><p>{2}</p>'
    '<p>{25}</p><p>{1}</p></article><footer>&copy; {2} {9}</footer>',
    '<header><a href="/">{2}</a><p>{5}</p></header><div class="cookie-notice">{22} <a>{2}</a></div><main data-label="keep"><h1>{6}</h1><p>{45}</p><h2>{3}</h2><p>{7}</p><ul><li>{4}</li><li>{6}</li></ul></main>'
    '<aside><h3>{3}</h3><p>{30}</p><ul><li><a>{6}</a></li></ul></aside><footer><p>{14}</p></footer>',
    '<div role="banner">{4}</div><div role="navigation"><a>{1}</a> <a>{1}</a> <a>{1}</a></div><div role="main" data-label="keep"><h1>{5}</h1><p>{80}</p><blockquote>{12}</blockquote><p>{3}</p></div><div role="complementary">{28}</div>',
    '<body><header><nav><a>{1}</a><a>{1}</a></nav></header><article data-label="keep"><header><h1>{9}</h1></header><p>{33}</p><figure><figcaption>{8}</figcaption></figure><p>{50} <a>{3}</a> {9}</p><section class="comments" '
    'data-label=""><h3>{2}</h3><article class="comment"><p>{24}</p></article><article class="comment"><p>{3}</p></article><form><label>{2}</label></form></section></article><footer>{11}</footer></body>',
    '<article data-label="keep"><h1>{7}</h1><p>{40}</p><aside class="related" data-label=""><ul><li><a>{5}</a></li><li><a>{7}</a></li></ul></aside><p>{22}</p><div class="share" data-label=""><a>{1}</a><a>{1}</a></div>'
    '<p>{4}</p></article><section id="disqus_thread"><p>{35}</p><p>{2}</p></section>',
    '<article data-label="keep"><h1><a>{7}</a></h1><p>{30} <a>{6}</a></p><p><a>{4}</a></p><ol><li><a>{5}</a> {9}</li><li>{1}</li></ol><table><tr><td>{1}</td><td>{2}</td></tr></table></article><div>{40}</div><div>{3}</div>',
    '<main data-label="keep"><p>{1}</p></main><div class="newsletter"><p>{26}</p></div><div>{18}</div>',
    '<article data-label="keep"><h1>{5}</h1><p>{30}</p><p>{2}</p><p>{1}</p></article>', '<nav><a>{1}</a></nav><article data-label="keep"><p>{1}</p><p>{4}</p><p>{2}</p><p>{1}</p><p>{3}</p></article>', '<main data-label="keep"><p>{3}</p></main>',
    # parts by classes
    '<div class="entry" data-label="keep"><p>{30}</p><p>{2}</p><p>{1}</p><p>{3}</p></div>', '<div class="story" data-label="keep"><p>{3}</p><p>{1}</p></div>',
    '<div id="top-menu"><a>{1}</a><a>{2}</a></div><div class="site-header">{4}</div><div class="post-content" data-label="keep"><h2>{6}</h2><p>{55}</p><p>{2}</p><p>{18}</p></div><div class="sidebar"><p>{30}</p></div><div>{9}</div>',
    '<div class="alert notice">{15}</div><div id="content" data-label="keep"><h1>{4}</h1><p>{10}</p><p>{44}</p><div class="ad-slot" data-label="">{16}</div><p>{1}</p></div><div id="comments"><div class="comment">{50}</div></div><div id="footer">{20}</div>',
    '<table><tr><td class="nav"><a>{1}</a></td><td class="story" data-label="keep"><p>{70}</p><p>{5}</p></td></tr></table><div>{24}</div><div class="copyright">{8}</div>',
    # parts by nothing
    '<div><a>{1}</a> <a>{1}</a> <a>{2}</a></div><h1 data-label="keep">{7}</h1><p data-label="keep">{48}</p><p data-label="keep">{12}</p><p data-label="keep">{65}</p><div><a>{4}</a></div><div>{4}</div>',
    '<p><a>{2}</a> | <a>{1}</a> | <a>{2}</a></p><div data-label="keep">{90}</div><div data-label="keep">{30}</div><div><a>{6}</a></div><div><a>{5}</a></div><p>{3} <a>{2}</a></p>',
    '<ul><li><a>{2}</a></li><li><a>{1}</a></li></ul><h2 data-label="keep">{5}</h2><div data-label="keep">{38} <a>{2}</a></div><div data-label="keep">{8}</div><div data-label="keep">{52}</div><div>{2} <a>{1}</a></div><div>{3}</div>',
    '<div data-label="keep"><p>{35}</p><p>{42}</p><p>{28}</p></div><ul><li><a>{8}</a></li><li><a>{9}</a></li><li><a>{7}</a></li></ul>',
    '<div><a>{1}</a></div><div><a>{2}</a></div><p data-label="keep">{40}</p><p data-label="keep">{3}</p><p data-label="keep">{2}</p><p data-label="keep">{4}</p><p data-label="keep">{33}</p><p data-label="keep">{1}</p><p data-label="keep">{47}</p>'
    '<div><a>{3}</a></div><div><a>{2}</a></div><div>{10}</div><div>{7}</div>',
    '<h1 data-label="keep">{6}</h1><p data-label="keep">{24}</p><p data-label="keep">{5}</p><p data-label="keep">{61}</p><p><a>{5}</a></p><p>{9} <a>{3}</a></p><p>{11}</p>',
    '<div class="content"><ul><li><a>{1}</a></li><li><a>{2}</a></li><li><a>{1}</a></li></ul><h1 data-label="keep">{5}</h1><p data-label="keep">{41}</p><p data-label="keep">{2}</p><p data-label="keep">{20} <a>{2}</a></p><ul><li><a>{4}</a></li>'
    '<li><a>{6}</a></li><li><a>{5}</a></li></ul></div>',
    '<p data-label="keep">{14}</p>', '<p data-label="keep">{30}</p><p data-label="keep">{9}</p>', '<div><a>{3}</a></div><div><a>{2}</a></div><div><a>{4}</a></div>',
    # no article at all
    '<nav><a>{1}</a></nav><div class="cookie-banner">{20}</div><footer>{10}</footer>', '<form><p>{5}</p><label>{2}</label></form><div class="login">{6}</div>',
)


def labelled() -> list[list[tuple[Block, bool]]]:
    """Of each page of the table: its blocks, and whether they are kept."""
    draw = random.Random(11)

    def words(found: re.Match) -> str:
        n = int(found[1])
        n = max(1, round(n * draw.uniform(0.6, 1.6))) if n > 2 else n
        return " ".join("word" for _ in range(n))

    pages = [re.sub(r"\{(\d+)\}", words, page) for _ in range(TIMES) for page in _PAGES]
    return [[(b, b.label == "keep") for b in blocks(page)] for page in pages]
