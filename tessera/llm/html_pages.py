"""Invented labelled pages, to train the extractor on: varied layouts, known main blocks."""

from __future__ import annotations

import random

_SYLLABLES = ("ka", "lo", "mi", "ten", "ra", "vos", "in", "pel", "dor", "su", "ech", "ali", "no", "gre", "st", "um", "é", "wa", "hi", "qu")


class Pages:
    def __init__(self, seed: int = 1):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def text(self, least: int, most: int, end: bool = True) -> str:
        n = self.r.randint(least, most)
        out, left = [], 0
        for i in range(n):
            w = self.word()
            if left == 0:
                w, left = w.capitalize(), self.r.randint(4, 18)
            left -= 1
            if end and (left == 0 or i == n - 1):
                w, left = w + self.r.choice("...?!"), 0
            elif self.r.random() < 0.08:
                w += ","
            elif self.r.random() < 0.02:
                w += self.r.choice((" &amp;", " &lt;3", "***", "%%%"))
            out.append(w)
        return " ".join(out)

    def links(self, n: int, sep: str = " ") -> str:
        return sep.join(f'<a href="/{self.word()}">{self.text(1, 3, False)}</a>' for _ in range(n))

    def wrap(self, tags: list[str], inner: str) -> str:
        tag = self.r.choice(tags)
        return f"<{tag}>{inner}</{tag.split()[0]}>"

    def inline(self, text: str) -> str:
        words = text.split(" ")
        for tag in ("a", "b", "em", "span"):
            if self.r.random() < 0.15:
                i = self.r.randrange(len(words))
                words[i] = f'<a href="/x">{words[i]}</a>' if tag == "a" else f"<{tag}>{words[i]}</{tag}>"
        return " ".join(words)

    def main(self) -> list[tuple[str, int]]:
        out = [(f"<h1>{self.text(3, 14, self.r.random() < 0.5)}</h1>", 1)] if self.r.random() < 0.85 else []
        for _ in range(self.r.randint(1, 14)):
            kind = self.r.random()
            if kind < 0.62:
                body = self.inline(self.text(*self.r.choice(((1, 6), (5, 30), (20, 120), (60, 250)))))
                out.append((self.r.choice((f"<p>{body}</p>", f"<p>{body}</p>", f"<p>{body}", f"<p><b>{body}<br>", f"<div>{body}</div>")), 1))
            elif kind < 0.7:
                out.append((f"<h{self.r.choice('234')}>{self.text(1, 8, False)}</h2>", 1))
            elif kind < 0.78:
                out += [("<ul>", 2), *((f"<li>{self.inline(self.text(1, 20))}</li>", 1) for _ in range(self.r.randint(2, 5))), ("</ul>", 2)]
            elif kind < 0.81:
                out.append((f"<blockquote>{self.text(8, 40)}</blockquote>", 1))
            elif kind < 0.84:
                out += [("<table>", 2), *((f"<tr><td>{self.text(1, 3, False)}</td>", 1) if i % 2 else (f"<tr><th>{self.text(1, 3, False)}</th>", 1) for i in range(4)), ("</table>", 2)]
            elif kind < 0.87:
                out.append((f"<pre>{self.text(5, 20, False)}</pre>", 1))
            else:
                out.append((self.junk_inside(), 0))
        return out

    def junk_inside(self) -> str:
        r = self.r
        box = lambda tags, inner: self.wrap(tags, r.choice((inner, f"<p>{inner}</p>", f"<div>{inner}</div>")))
        return r.choice((
            lambda: box(['div class="ad"', 'div class="advert banner"', 'div id="ad-slot"', 'div class="ad-box"', 'div class="ads sponsored"', 'aside class="promo"', 'section class="advertisement"', "aside"], self.text(2, 40)),
            lambda: self.wrap(['div class="share social"', 'div class="related"', 'aside class="related-posts"', 'nav class="toc"', "nav", 'ul class="tags menu"'], self.links(r.randint(2, 5))),
            lambda: box(['div class="newsletter signup"', "form", 'form class="subscribe"'], self.text(3, 25)),
            lambda: box(['div class="notice"', 'div class="cookie-notice"', 'p class="notice alert"', 'div class="warning banner"', 'div role="alert"'], self.text(4, 40)),
            lambda: self.wrap(['section class="comments"', 'div id="comments"', 'div class="comment-list reader"', 'section id="responses"'], self.wrap(["h2", "h3"], self.text(1, 3, False)) + "".join(self.wrap(["p", 'div class="comment"', 'article class="comment"', "li"], self.text(4, 80)) for _ in range(r.randint(1, 4)))),
            lambda: box(['div class="sidebar"', 'aside class="widget"', "footer", 'div class="footer"'], self.text(3, 40)),
        ))()

    def junk(self, where: str) -> list[str]:
        r, out = self.r, []
        if where == "top":
            if r.random() < 0.5:
                out.append(self.wrap(["header", 'div id="header"', 'div class="site-header masthead"', 'header class="top"'], self.wrap(["div", 'div class="logo"', "h2", "p"], self.text(1, 5, False)) + self.links(r.randint(0, 3))))
            if r.random() < 0.85:
                items = "".join(f"<li>{self.links(1)}</li>" for _ in range(r.randint(2, 9)))
                out.append(self.wrap(["nav", "nav", 'div class="menu"', 'div id="navbar"', 'ul class="nav"', 'div role="navigation"'], r.choice((f"<ul>{items}</ul>", items, self.links(r.randint(2, 8), " | ")))))
            if r.random() < 0.3:
                out.append(self.wrap(['div class="breadcrumb"', 'p class="breadcrumbs"', 'ol class="breadcrumb"'], self.links(3, " &gt; ")))
            if r.random() < 0.3:
                out.append(self.wrap(['div class="cookie-notice"', 'div id="cookie-banner"', 'div class="notice alert"', 'section class="consent"', 'div class="gdpr"', 'div role="alert"'], f"<p>{self.text(5, 40)}</p>"))
            if r.random() < 0.15:
                out.append(self.wrap(['form class="search"', 'form action="/login"'], f"<label>{self.text(1, 3, False)}</label><p>{self.text(1, 8)}</p>"))
        else:
            if r.random() < 0.35:
                body = "".join(self.wrap(["p", 'div class="comment"', "li"], self.text(3, 60)) for _ in range(r.randint(1, 6)))
                out.append(self.wrap(['div id="comments"', 'section class="comments"', 'div class="comment-list"', 'section id="responses"', 'div class="discussion"'], self.wrap(["h2", "h3"], self.text(1, 4, False)) + body))
            if r.random() < 0.3:
                out.append(self.wrap(["aside", 'div class="sidebar"', 'div id="sidebar"', 'aside class="widget"'], self.wrap(["h3", "h4"], self.text(1, 3, False)) + self.wrap(["p", "div"], self.text(3, 40)) + self.links(r.randint(0, 5))))
            if r.random() < 0.25:
                out.append(self.wrap(['div class="related"', 'section class="more-stories"', 'div class="recommended"'], "".join(f"<p>{self.links(1)}</p>" for _ in range(4))))
            if r.random() < 0.2:
                out.append(self.wrap(['form class="subscribe"', "form", 'div class="newsletter"'], f"<p>{self.text(3, 25)}</p><label>{self.text(1, 3, False)}</label>"))
            if r.random() < 0.85:
                out.append(self.wrap(["footer", "footer", 'div id="footer"', 'div class="site-footer"'], r.choice((f"&copy; {self.word()} &middot; {self.text(3, 20)}", f"<p>&copy; 2020 {self.text(1, 6)}</p>{self.links(3)}", self.links(r.randint(2, 6))))))
        if r.random() < 0.4:
            out.append(self.wrap(['div class="ad"', 'div class="ads"', 'div class="sponsored"', 'div class="banner promo"', "aside", 'div style="display:none"'], r.choice((self.text(2, 40), f"<p>{self.text(2, 40)}</p>"))))
        r.shuffle(out)
        return out

    def page(self) -> tuple[list[tuple[str, int]]]:
        """Pieces of a page, each with 1: main text, 0: other text, 2: no text of its own."""
        if self.r.random() < 0.06:  # no layout at all
            return [(self.text(5, 120), 1)] if self.r.random() < 0.5 else [(f"<p>{self.text(5, 80)}</p>", 1) for _ in range(self.r.randint(1, 6))]
        holder = self.r.choice(("article", "article", "article", "main", 'div class="content"', 'div id="content"', 'div class="post entry"', 'div class="article-body"', 'section class="story"', "div", None))
        pieces = [("<!DOCTYPE html><html><head><title>", 2), ("x</title></head><body>", 2)]
        pieces += [(p, 0) for p in self.junk("top")]
        wrap = self.r.choice((None, None, "div", 'div class="wrapper"', "main"))
        pieces += [(f"<{wrap}>", 2)] if wrap else []
        pieces += [(f"<{holder}>", 2)] if holder else []
        pieces += self.main()
        pieces += [(f"</{holder.split()[0]}>", 2)] if holder else []
        pieces += [(p, 0) for p in self.junk("bottom")]
        pieces += [(f"</{wrap.split()[0]}>", 2)] if wrap else []
        return pieces + [("</body></html>", 2)]


    def control(self) -> str:
        """A control, or what browsers show in place of embedded content."""
        r, tag = self.r, self.r.choice(("button", "select", "noscript", "template", "iframe", "canvas", "object", "audio", "video"))
        if tag == "button":
            return self.wrap(["button", 'button type="submit"', 'button class="share"'], self.text(1, 4, False))
        if tag == "select":
            return self.wrap(["select", 'select name="x"'], "".join(f"<option>{self.text(1, 3, False)}</option>" for _ in range(r.randint(2, 5))))
        text = self.text(3, 25)
        return f"<{tag}>{r.choice((text, f'<p>{text}</p>'))}</{tag}>"


def labelled(n: int, seed: int = 1) -> list[list[tuple[str, int]]]:
    made = Pages(seed)
    return [made.page() for _ in range(n)]


def with_controls(n: int, seed: int = 1) -> list[list[tuple[str, int]]]:
    """Other labelled pages, with controls at some places between their pieces."""
    made, out = Pages(seed + 1_000_000), []
    for _ in range(n):
        page = made.page()
        for _ in range(made.r.randint(1, 4)):
            page.insert(made.r.randint(min(2, len(page)), len(page)), (made.control(), 0))
        out.append(page)
    return out
