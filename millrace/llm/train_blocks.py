"""Trains the block labeller on pages made here and writes its weights: ``python -m millrace.llm.train_blocks``.

The pages are made up from many layouts: an article in one of several containers, among menus, headers, footers,
side columns, notices, adverts, forms and reader comments, all with names as sites use them. Words are invented for
every page, apart from the stock phrases of menus and notices.
"""

from __future__ import annotations

import random
from pathlib import Path

import numpy as np

from millrace.llm import lstm
from millrace.llm.html_blocks import blocks_of, features

WEIGHTS = Path(__file__).with_name("block_labeller.npz")
_SOUNDS = "an en on in er re th st nd ti es or he ou ea ha ing ed le la de que ion ment eau sch ung ver ge ció ado os el al ar ka to mi na ro si".split()
#: Marks what the article holds; no page has it otherwise.
_MARK = "\ue000"

MENU = "Home|News|Sport|About us|Contact|Login|Sign up|Search|Archive|Topics|Videos|Shop|Help|Next|Previous|Share|Print|Tags|More|Privacy|Imprint|Impressum|Accueil|Inicio|Startseite".split("|")
STOCK = {
    "notice": "We use cookies to improve this site. Accept all|This site uses cookies.|You have read 3 of 5 free articles.|Please enable JavaScript.|Subscribe to our newsletter|Accept|Reject all|Manage settings",
    "foot": "All rights reserved.|© 2021 Example Ltd|Terms of use|Privacy policy|Contact us|Powered by Example|Back to top|Follow us",
    "advert": "Advertisement|Sponsored|Buy now and save 20%|Limited offer|Promoted content|Anzeige|Publicité",
    "comment": "Reply|3 comments|Report|Leave a comment|Great article, thanks!|I don't agree with this at all.|Posted by anna 2 days ago|Like",
    "form": "Your email|Name|Send|Submit|Search|Password|Sign in|Message|Enter your address",
}
NAMES = {
    "menu": "nav:|nav:main-nav|div:menu|div:navbar|ul:nav|ul:menu top|div:breadcrumb|ol:breadcrumbs|div:topbar|nav:site-navigation|div:pagination|div:toc|div:tabs|div:submenu",
    "head": "header:|header:site-header|div:header|div:masthead|div:logo|div:banner|div:top|header:page-header|div:site-title",
    "foot": "footer:|footer:site-footer|div:footer|div:copyright|div:bottom|div:legal|section:footer-links|div:credits",
    "side": "aside:|aside:sidebar|div:sidebar|div:side|div:related|div:related-posts|section:recommended|div:widget|div:trending|div:popular|div:rail|aside:more|div:author-box|div:share|div:social|div:tags|ul:tags|div:teaser",
    "notice": "div:cookie|div:cookie-banner|div:notice|div:consent|div:gdpr|div:alert|div:popup|div:modal|dialog:|div:overlay|div:newsletter|div:paywall|section:subscribe|div:notification",
    "advert": "div:ad|div:ads|div:advert|div:ad-slot|aside:ad|div:sponsor|div:promo|div:promoted|ins:adsbygoogle|div:banner-ad|section:advertisement|div:sponsored",
    "comment": "div:comments|section:comments|ol:comment-list|div:comment|div:discussion|div:responses|ul:commentlist|div:disqus|section:reader-comments|div:replies",
    "form": "form:|form:search|form:login|div:search|form:contact|fieldset:|form:newsletter-form|form:comment-form",
}
CONTENT = "article:|article:post|main:|main:content|div:content|div:post|div:entry-content|div:article-body|section:story|div:post-content|div:text|div:story-body|div:main|article:entry|div:article|section:article|div:body|div:page-content"
WRAP = "div:|div:|div:container|div:wrapper|div:row|section:|div:page|div:layout|div:col|div:grid|div:inner|div:outer|div:site|section:wrap|div:app|div:root|span:"


class Maker:
    def __init__(self, seed: int):
        self.rng = random.Random(seed)
        self.junk = self.rng.random() < 0.15
        self.digits = self.rng.choice((0.0, 0.01, 0.05, 0.3))

    def word(self) -> str:
        if self.rng.random() < self.digits:
            return str(self.rng.randrange(10 ** self.rng.randint(1, 16)))
        return "".join(self.rng.choice(_SOUNDS) for _ in range(self.rng.choice((1, 1, 2, 2, 3, 4)))) + (self.rng.choice(("***", "%%%", "###", "$$$", "&amp;&amp;")) if self.junk else "")

    def words(self, least: int, most: int) -> str:
        n = self.rng.randint(least, most)
        if self.rng.random() < 0.02:
            return " ".join([self.word()] * n)
        out, first = [], True
        for i in range(n):
            w = self.word()
            out.append(w.capitalize() if first else w)
            first = self.rng.random() < 0.12
            out[-1] += "." if first or i == n - 1 else "," if self.rng.random() < 0.06 else ""
        return " ".join(out) if self.rng.random() < 0.9 else " ".join(out).rstrip(".")

    def phrase(self) -> str:
        return self.words(3, 9).rstrip(".") if self.rng.random() < 0.5 else self.words(4, 30)

    def tag(self, spec: str, inner: str) -> str:
        name, _, cls = spec.partition(":")
        attr = ""
        if cls:
            attr = f' {self.rng.choice(("class", "class", "id"))}="{cls}"'
        return f"<{name}{attr}>{inner}</{name}>"

    def pick(self, kind: str) -> str:
        return self.rng.choice(NAMES[kind].split("|"))

    def menu_item(self) -> str:
        text = self.rng.choice(MENU) if self.rng.random() < 0.4 else self.word() if self.rng.random() < 0.6 else self.words(2, 4)
        return f'<a href="/{self.rng.randrange(999)}">{text}</a>'

    def boiler(self, kind: str) -> str:
        rng = self.rng
        if kind == "menu":
            items = [self.menu_item() for _ in range(rng.randint(2, 9))]
            style = rng.random()
            inner = "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if style < 0.6 else "".join(f"<div>{x}</div>" for x in items) if style < 0.75 else " | ".join(items)
            return self.tag(self.pick("menu"), inner)
        if kind == "head":
            return self.tag(self.pick("head"), rng.choice((f"<h1>{self.words(1, 4)}</h1>", f"<a href='/'>{self.words(1, 3)}</a>", f"<p>{self.words(2, 10)}</p>", f"<span>{self.words(1, 5)}</span>")) + (self.boiler("menu") if rng.random() < 0.4 else ""))
        if kind == "side":
            inner = [f"<h3>{self.words(1, 4)}</h3>"] * (rng.random() < 0.5) + [rng.choice((f"<p>{self.phrase()}</p>", f"<ul><li>{self.menu_item()}</li><li>{self.menu_item()}</li></ul>", f"<div><a href='#'>{self.phrase()}</a></div>", f"<div>{self.phrase()}</div>")) for _ in range(rng.randint(1, 5))]
            return self.tag(self.pick("side"), "".join(inner))
        if kind == "comment":
            one = lambda: self.tag(rng.choice(("div:comment", "li:comment", "p:", "article:comment", "div:reply")), rng.choice((f"<p>{self.words(3, 40)}</p>", self.words(3, 40), f"<b>{self.word()}</b><p>{rng.choice(STOCK['comment'].split('|'))}</p>", f"<cite>{self.word()}</cite><p>{self.words(3, 40)}</p>")))
            return self.tag(self.pick("comment"), (f"<h3>{rng.choice(('Comments', 'Kommentare', 'Responses', 'Leave a reply'))}</h3>" if rng.random() < 0.5 else "") + "".join(one() for _ in range(rng.randint(1, 6))))
        if kind == "form":
            return self.tag(self.pick("form"), "".join(rng.choice((f"<label>{rng.choice(STOCK['form'].split('|'))}</label><input>", f"<button>{rng.choice(STOCK['form'].split('|'))}</button>", f"<p>{self.words(2, 12)}</p>", f"<label>{self.words(1, 3)}</label>")) for _ in range(rng.randint(1, 5))))
        stock = rng.choice(STOCK[kind].split("|"))
        text = stock if rng.random() < 0.4 else f"&copy; {self.word()}.example.net &middot; {self.words(3, 12)}" if kind == "foot" and rng.random() < 0.5 else self.phrase()
        inner = text if rng.random() < 0.5 else "".join(rng.choice((f"<p>{text}</p>", f"<p>{self.phrase()}</p>", f"<a href='#'>{self.words(1, 4)}</a>", f"<div>{self.phrase()}</div>", f"<button>{self.words(1, 2)}</button>")) for _ in range(rng.randint(1, 3)))
        return self.tag(self.pick(kind), inner)

    def article(self) -> str:
        rng = self.rng
        n = int(rng.expovariate(0.12)) + 1
        out = [rng.choice(("<h1>{}</h1>", "<h1>{}</h1>", "<h2>{}</h2>", "<header><h1>{}</h1></header>", "")).format(f"{_MARK}{self.words(2, 12)}")]
        bold = rng.random() < 0.3
        for _ in range(n):
            text = _MARK + (self.words(1, 4) if rng.random() < 0.2 else self.words(5, 120))
            x = rng.random()
            if bold and x < 0.25:
                out.append(f"<p><b>{text}<br>")
            elif x < 0.78:
                if rng.random() < 0.15:
                    text += f" <a href='#'>{self.words(1, 5)}</a> {self.words(2, 9)}"
                out.append(f"<p>{text}</p>" if rng.random() < 0.9 else f"<p>{text}")
            elif x < 0.82:
                out.append(f"<h{rng.choice('234')}>{_MARK}{self.words(1, 8)}</h{rng.choice('234')}>")
            elif x < 0.87:
                out.append("<ul>" + "".join(f"<li>{_MARK}{self.words(1, 25)}</li>" for _ in range(rng.randint(1, 6))) + "</ul>")
            elif x < 0.9:
                out.append(f"<blockquote>{text}</blockquote>")
            elif x < 0.92:
                out.append(f"<table><tr><td>{_MARK}{self.words(1, 4)}</td><td>{_MARK}{self.words(1, 4)}</td></tr></table>")
            elif x < 0.94:
                out.append(f"<figure><img src='x'><figcaption>{text}</figcaption></figure>")
            elif x < 0.96:
                out.append(f"<div>{text}</div>")
            elif x < 0.97:
                out.append(f"<pre>{text}</pre>")
            else:
                out.append(self.boiler(rng.choice(("advert", "side", "notice", "form", "menu", "comment"))))
        spec = rng.choice(CONTENT.split("|"))
        if rng.random() < 0.06:  # a line that comes again and again
            out[1:1] = [rng.choice(out[1:])] * rng.randint(2, 40)
        inner = "".join(out)
        if rng.random() < 0.3:
            inner = self.tag(rng.choice(CONTENT.split("|")), inner)
        if rng.random() < 0.15:
            inner += self.boiler(rng.choice(("comment", "side", "foot")))
        return self.tag(spec, inner)

    def nested(self, inner: str) -> str:
        """Inside wrappers, few or very many, some of which are never closed."""
        rng = self.rng
        specs = rng.choices(WRAP.split("|"), k=rng.randint(1, 4))
        for _ in range(rng.choice((0, 0, 0, 1, 1, 2, 4, 8, 14))):
            inner = self.tag(rng.choice(specs), inner)
            if rng.random() < 0.06:
                inner = inner[: inner.rindex("</")]
        return inner

    def page(self) -> str:
        rng = self.rng
        before = [k for k, p in (("notice", 0.3), ("head", 0.4), ("menu", 0.75), ("advert", 0.45), ("form", 0.2), ("side", 0.25)) if rng.random() < p]
        after = [k for k, p in (("side", 0.35), ("advert", 0.25), ("comment", 0.35), ("form", 0.2), ("menu", 0.15), ("foot", 0.8), ("notice", 0.2)) if rng.random() < p]
        if rng.random() < 0.3:
            rng.shuffle(before)
            rng.shuffle(after)
        main = self.article() if rng.random() < 0.97 else ""
        main = self.nested(main + (self.boiler("side") if rng.random() < 0.12 else ""))
        around = lambda kinds: "".join(self.nested(self.boiler(k)) if rng.random() < 0.4 else self.boiler(k) for k in kinds)
        whole = around(before) + main + around(after)
        return f"<html><head><title>{self.words(2, 9)}</title></head><body>" + (self.nested(whole) if rng.random() < 0.3 else whole) + "</body></html>"


def labelled(seed: int) -> tuple[str, np.ndarray, np.ndarray]:
    """A page, its blocks' features and whether each is of the article."""
    html = Maker(seed).page()
    found = blocks_of(html)
    y = np.array([_MARK in text for _, text, _ in found], np.float32)
    clean = [(path, text.replace(_MARK, ""), linked) for path, text, linked in found]
    return html.replace(_MARK, ""), features(clean) if clean else np.zeros((0, 1), np.float32), y


def main(pages: int = 24_000) -> None:
    made = [m for m in map(labelled, range(pages)) if len(m[2])]
    held = made[: len(made) // 10]
    w = lstm.train([m[1] for m in made[len(held) :]], [m[2] for m in made[len(held) :]], hidden=24, epochs=10)
    odds = np.concatenate(lstm.scores(w, [m[1] for m in held]))
    y = np.concatenate([m[2] for m in held])
    print(f"held-out blocks {len(y)}, right {np.mean((odds > 0) == (y > 0)):.4f}; pages wholly right {np.mean([np.array_equal(o > 0, m[2] > 0) for o, m in zip(lstm.scores(w, [m[1] for m in held]), held)]):.4f}")
    np.savez_compressed(WEIGHTS, **{k: v.astype(np.float16) for k, v in w.items()})


if __name__ == "__main__":
    main()
