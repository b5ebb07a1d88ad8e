"""Labelled pages that train the extractor: layouts of common kinds of sites with the article marked.

``{article}`` stands for a marked article; everything else is not main text. Blocks are filled with words
of a seeded generator, so that lengths, links and punctuation vary.
"""

from __future__ import annotations

import random

#: The attribute that marks content in a labelled page; whatever is inside it is content.
MARK = "data-content"

_LAYOUTS = [
    "<body><header><h2>{s}</h2>{menu}</header><main><article {m}>{body}</article></main><aside>{links}</aside><footer>{fine}</footer></body>",
    "<body>{menu}<div class=\"ad\">{s}</div><article {m}>{body}</article><footer>{fine}</footer></body>",
    "<body><div id=\"header\"><a href=\"/\">{s}</a></div><div id=\"nav\">{links}</div><div id=\"content\" {m}>{body}</div><div id=\"sidebar\"><h3>{s}</h3>{links}<p>{p}</p></div><div id=\"footer\">{fine}</div></body>",
    "<body><div class=\"cookie-notice\"><p>{p}</p><button>{s}</button></div><div class=\"wrapper\"><div class=\"menu\">{links}</div><div class=\"post\"><div class=\"entry-content\" {m}>{body}</div><div class=\"share\">{links}</div></div><div class=\"comments\"><h3>{s}</h3><div class=\"comment\"><p>{p}</p></div><div class=\"comment\"><p>{p} {p}</p></div></div></div></body>",
    "<body><nav>{links}</nav><main {m}>{body}</main><section class=\"related\"><h2>{s}</h2>{links}</section><form action=\"/\"><label>{s}</label><input type=\"text\"><p>{s}</p></form><footer><p>{p}</p>{links}</footer></body>",
    "<body><div class=\"banner\">{p}</div><div class=\"page\"><div class=\"article\" {m}>{body}</div></div><div class=\"newsletter\"><p>{p}</p></div><div class=\"bottom\">{fine}</div></body>",
    "<body><header><p>{p}</p></header><article><header {m}><h1>{s}</h1></header><div {m}>{body}</div><aside class=\"promo\"><p>{p}</p></aside><div {m}>{body}</div><footer><p>{s}</p>{links}</footer></article><section id=\"comments\"><article class=\"comment\"><p>{p}</p></article><article class=\"comment\"><p>{p}</p><p>{p}</p></article></section></body>",
    "<body><table><tr><td class=\"left\">{links}</td><td {m}>{body}</td></tr></table><div class=\"footer\">{fine}</div></body>",
    "<body>{menu}<div class=\"alert\"><p>{p}</p></div><section {m}>{body}</section><aside><p>{p} {p}</p></aside><div class=\"advert\"><p>{p}</p></div><footer>{fine}</footer></body>",
    "<body><article {m}>{body}</article></body>",
    "<body><main><h1 {m}>{s}</h1><div class=\"notice\">{p}</div><section {m}>{body}</section><section class=\"responses\"><h2>{s}</h2><ol><li class=\"comment\"><p>{p}</p></li><li class=\"comment\"><p>{p}</p></li></ol></section></main><div role=\"contentinfo\">{fine}</div></body>",
    "<body><div role=\"banner\">{s}</div><div role=\"navigation\">{links}</div><div role=\"main\" {m}>{body}</div><div role=\"complementary\"><p>{p}</p></div><dialog><p>{p}</p></dialog></body>",
    "<body>{menu}<div class=\"ad\">{p}</div><article {m}>{loose}</article><footer>{fine}</footer></body>",
    "<body><div class=\"container\">{menu}<div class=\"text\" {m}>{loose}</div><div class=\"popup\"><p>{p}</p></div><footer>{p}</footer></div></body>",
    "<body><main {m}>{body}</main></body>",
]


class _Filler:
    def __init__(self, seed: int):
        self.random = random.Random(seed)

    def words(self, least: int, most: int) -> str:
        pick = self.random
        out = ["".join(pick.choice("aeiourstnldmpch") for _ in range(pick.randint(1, 9))) for _ in range(pick.randint(least, most))]
        return " ".join(out)

    def sentence(self) -> str:
        return self.words(4, 18).capitalize() + self.random.choice("...?!")

    def p(self) -> str:
        if self.random.random() < 0.25:  # prose without stops
            return self.words(3, 120)
        return " ".join(self.sentence() for _ in range(self.random.randint(1, 9)))

    def s(self) -> str:
        return self.words(1, 7)

    def links(self) -> str:
        inside = "".join(f"<li><a href=\"/x\">{self.s()}</a></li>" for _ in range(self.random.randint(3, 9)))
        return f"<ul>{inside}</ul>"

    def menu(self) -> str:
        return f"<nav>{self.links()}</nav>"

    def fine(self) -> str:
        return f"&copy; {self.s()} &middot; {self.random.choice([self.sentence(), self.p(), self.links()])}"

    def body(self) -> str:
        pick = self.random
        if pick.random() < 0.12:  # an article of one short paragraph
            return f"<p>{self.sentence()}</p>"
        out = [f"<h1>{self.s()}</h1>"]
        for _ in range(pick.randint(1, 9)):
            kind = pick.random()
            if kind < 0.55:
                out.append(f"<p>{self.p()}</p>")
            elif kind < 0.58:
                name = pick.choice(["span class=\"more\"", "code class=\"language-text\"", "b class=\"text\"", "span class=\"main\""])
                out.append(f"<p>{self.sentence()} <{name}>{self.s()}</{name.split()[0]}> {self.sentence()}</p>")
            elif kind < 0.62:
                out.append(f"<p>{self.sentence()} <a href=\"/y\">{self.s()}</a> {self.sentence()}</p>")
            elif kind < 0.68:
                out.append(f"<h2>{self.s()}</h2>")
            elif kind < 0.74:
                out.append("<ul>" + "".join(f"<li>{self.sentence()}</li>" for _ in range(pick.randint(2, 5))) + "</ul>")
            elif kind < 0.79:
                out.append(f"<blockquote><p>{self.p()}</p></blockquote>")
            elif kind < 0.84:
                out.append(f"<p>{self.s()}</p>")
            elif kind < 0.88:
                out.append(f"<table><tr><th>{self.s()}</th><td>{self.s()}</td></tr></table>")
            elif kind < 0.92:
                out.append(f"<pre><code>{self.s()}</code></pre>")
            elif kind < 0.96:
                out.append(f"<div><p>{self.p()}</p></div>")
            else:
                out.append(f"<figure><figcaption>{self.sentence()}</figcaption></figure>")
        return "".join(out)

    def loose(self) -> str:
        """Paragraphs whose end tags are missing, as hand-written pages have them."""
        parts = [f"<p><b>{self.p()}<br>" if self.random.random() < 0.3 else f"<p>{self.p()}" for _ in range(self.random.randint(1, 8))]
        return f"<h1>{self.s()}</h1>" + "".join(parts)


def labelled_pages(rounds: int = 10) -> list[str]:
    """``rounds`` pages of each layout."""
    pages = []
    for seed in range(rounds):
        for number, layout in enumerate(_LAYOUTS):
            filler, html = _Filler(seed * 100 + number), layout
            for name in ("menu", "links", "fine", "body", "loose", "p", "s"):
                while "{" + name + "}" in html:
                    html = html.replace("{" + name + "}", getattr(filler, name)(), 1)
            pages.append(f"<!DOCTYPE html><html><head><title>{filler.s()}</title></head>{html.replace('{m}', MARK)}</html>")
    return pages
