"""Labelled pages to train the block labeller on, made up from many layouts with a fixed seed.

A private-use character marks main text in the made-up HTML; after parsing it becomes the label and is removed.
"""

from __future__ import annotations

import random

from .html import Block, leaf_blocks

MARK = "\ue000"

_SYLLABLES = "an ber co de er fi ga hen in jo ka le mo na or pe qui ra se tion un ve wa xi yo zu é ü ñ ção сти бо ли 中文 かな".split()
_ENDINGS = [".", ".", ".", "!", "?", "…", ""]

_CONTENT = ["article", "main", "div.content", "div.post", "div.entry-content", "div.article-body", "div.story", "div.post-content", "div#content", "section.text", "div#main", "div.page", "div.body-text", "div.markdown", "td.content", "div", "section", "article.post", "div.articletext", "div.news-text"]
_SIDE = ["aside", "div.sidebar", "div#sidebar", "div.widget", "div.related", "section.related", "aside.sidebar", "div.right-column", "div.popular", "div.trending", "div.recommended", "ul.tags", "div.side", "div.secondary", "div.toc"]
_HEAD = ["header", "div.header", "div#header", "div.masthead", "div.topbar", "div.site-header", "div.branding", "div.logo", "header.banner"]
_NAV = ["nav", "div.nav", "ul.menu", "div.menu", "div.navbar", "ul.breadcrumb", "div.breadcrumbs", "nav.pagination", "div.pager", "div#navigation", "menu", "ol.breadcrumb", "div.links", "div.skip"]
_FOOT = ["footer", "div.footer", "div#footer", "div.copyright", "div.site-footer", "div.legal", "footer.bottom", "div.colophon"]
_NOTICE = ["div.cookie", "div.cookie-banner", "div.notice", "div.alert", "div.consent", "div.gdpr", "div.popup", "div.modal", "div.paywall", "div.banner", "section.notice", "div.warning", "div.disclaimer", "div.overlay", "dialog"]
_ADS = ["div.ad", "div.ads", "div.advert", "div.advertisement", "div.sponsored", "div.promo", "aside.ad", "section.ad", "div.ad-slot", "p.ad", "div.promotion", "ins.adsbygoogle", "div.banner-ad", "div.sponsor", "figure.ad"]
_FORM = ["form", "form.search", "div.newsletter", "div.subscribe", "form.login", "div.signup", "form.comment-form", "fieldset", "div.searchbox", "div.login-form"]
_COMMENTS = ["div.comments", "section.comments", "div#comments", "ol.commentlist", "div.comment-section", "ul.comment-list", "div.disqus", "div.discussion", "div.replies", "div.responses", "section#comments", "div.user-comments"]
_SHARE = ["div.share", "ul.social", "div.social-links", "div.toolbar", "div.sharing"]

_PHRASES = {
    "notice": ["This site uses cookies to improve your experience.", "We value your privacy.", "We and our partners ask for your consent to store cookies.", "You can withdraw consent in the privacy settings.", "Accept all cookies", "Nous utilisons des cookies.", "Diese Website verwendet Cookies.", "Usamos cookies.", "Please enable JavaScript.", "You have reached your free article limit."],
    "ad": ["Advertisement", "Sponsored content", "Buy now and save", "Anzeige", "Publicité", "Publicidad", "Special offer"],
    "form": ["Subscribe to our newsletter", "Search", "Sign in", "Your email address", "Log in", "Leave a comment", "Submit", "Password"],
    "foot": ["© 2024 {w} Inc.", "All rights reserved.", "Copyright 2023 {w}", "© {w} · {w}", "Terms of use", "Privacy policy", "Contact us", "Impressum"],
    "share": ["Share", "Tweet", "Follow us", "Share on Facebook", "Partager", "Teilen"],
    "more": ["Related articles", "Read more", "Most read", "You may also like", "Recommended", "Popular posts"],
    "reply": ["{n} comments", "Reply", "{w} says:", "Posted by {w}", "Comments", "Report"],
}


#: What an article may say that notices say, too.
_INCIDENTAL = [
    "We use cookies to bake.", "Subscribe to this idea.", "He left a comment and did not reply.", "They share a promo code.", "The law on privacy was read out.", "A sponsor paid for the bridge.",
    "She asked for their consent.", "The related case was dropped.", "It was the most popular book of 12.3.1999.", "He kept the copyright.", "They signed up, and read more.",
]


class _Page:
    def __init__(self, rng: random.Random):
        self.r = rng
        self.alphabet = rng.sample(_SYLLABLES[:23], 12) + rng.sample(_SYLLABLES[23:], rng.choice([0, 0, 2, 4]))

    def word(self) -> str:
        return "".join(self.r.choice(self.alphabet) for _ in range(self.r.choice([1, 1, 2, 2, 2, 3, 4])))

    def words(self, n: int) -> str:
        return " ".join(self.word() for _ in range(n))

    def sentence(self, most: int = 25) -> str:
        w = [self.word() + ("," if self.r.random() < 0.08 else "") for _ in range(self.r.randint(1, most))]
        return " ".join(w).capitalize() + self.r.choice(_ENDINGS)

    def prose(self) -> str:
        style = self.r.random()
        n = self.r.choice([1, 1, 1, 2, 3, 4, 6, 9])
        t = " ".join(self.sentence() for _ in range(n))
        if style < 0.06:
            t = " ".join(w + self.r.choice(["###", "***", "&&&", "%%%", "!!"]) for w in t.split())
        elif style < 0.09:
            t = t.upper()
        elif style < 0.12:
            t = " | ".join(t.split())
        elif style < 0.15:
            t = self.words(self.r.randint(1, 3))
        elif style < 0.18:
            t += f" {self.r.randint(1, 999)}.{self.r.randint(1, 255)} {self.word()}@{self.word()}.example.com +1 (555) 555-{self.r.randint(1000, 9999)}"
        elif style < 0.20:
            t = self.r.choice(["Released under the MIT License.", "All rights reserved.", "Licensed under CC BY 4.0.", f"Copyright {self.word()}."]) if self.r.random() < 0.5 else t + " All rights reserved."
        elif style < 0.22:
            t += " " + self.r.choice(_INCIDENTAL)
        elif style < 0.30 and n > 2:  # words that notices use, in the midst of a long paragraph
            t = " ".join(self.r.choice(_INCIDENTAL) if self.r.random() < 0.15 else self.sentence() for _ in range(2 * n))
        return t

    def long(self, what: str) -> str:
        """A notice, advert or the like of many sentences, most of them about the matter."""
        about = self.r.choice([0.4, 0.6, 0.9])
        return " ".join(self.say(what) if self.r.random() < about else self.sentence(12) for _ in range(self.r.randint(4, 24)))

    def wrap(self, kind: str, inner: str, extra: str = "") -> str:
        tag, mark, name = kind, "", ""
        for sep, attr in ((".", "class"), ("#", "id")):
            if sep in kind:
                tag, name = kind.split(sep)
                more = f" {self.word()}" if self.r.random() < 0.2 and attr == "class" else ""
                mark = f' {attr}="{name}{more}"'
        if not mark and self.r.random() < 0.25:
            mark = f' class="{self.word()}"'
        return f"<{tag}{mark}{extra}>{inner}</{tag}>"

    def link(self, t: str) -> str:
        return f'<a href="/{self.word()}">{t}</a>'

    def menu(self, least: int = 1) -> str:
        items = [self.link(self.words(self.r.choice([1, 1, 2, 3]))) for _ in range(self.r.randint(least, 8))]
        return self.r.choice(["<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", " ".join(items), " | ".join(items), "".join(f"<div>{x}</div>" for x in items), "".join(f"<li>{x}" for x in items)])

    def say(self, what: str) -> str:
        return self.r.choice(_PHRASES[what]).format(w=self.word().capitalize(), n=self.r.randint(0, 99))

    def main(self, t: str) -> str:
        """Main text, with a mark in each stretch that makes a block of its own."""
        r = self.r.random()
        if r < 0.1:
            w = t.split(" ")
            k = self.r.randrange(len(w))
            w[k] = self.r.choice([f"<b>{w[k]}</b>", self.link(w[k]), f"<em>{w[k]}</em>", f"<code>{w[k]}</code>", f"<span class='x'>{w[k]}</span>"])
            t = " ".join(w)
        return MARK + t

    def content(self) -> str:
        out = []
        r = self.r
        h = r.choice(["h1", "h1", "h1", "h2"])
        title = self.main(self.sentence(9))
        if r.random() < 0.85:
            head = f"<{h}>{title}</{h}>"
            if r.random() < 0.15:
                head = f"<header>{head}</header>"
            out.append(head)
        open_p = r.random() < 0.25
        for _ in range(r.choice([0, 1, 1, 2, 3, 4, 6, 8, 12])):
            k = r.random()
            if k < 0.68:
                p = self.main(self.prose())
                if r.random() < 0.15:
                    p = f"<b>{p}" + ("</b>" if r.random() < 0.4 else "<br>")
                elif r.random() < 0.1:
                    p += "<br>" + self.prose()
                out.append(f"<p>{p}" + ("" if open_p or r.random() < 0.1 else "</p>"))
            elif k < 0.76:
                out.append(f"<{r.choice(['h2', 'h3', 'h4'])}>{self.main(self.sentence(6))}</h2>")
            elif k < 0.83:
                kind = r.choice(["ul", "ol"])
                out.append(f"<{kind}>" + "".join(f"<li>{self.main(self.sentence(12))}" + r.choice(["", "</li>"]) for _ in range(r.randint(1, 5))) + f"</{kind}>")
            elif k < 0.88:
                out.append(f"<blockquote>{self.main(self.prose())}</blockquote>")
            elif k < 0.91:
                out.append(f"<pre>{self.main(self.prose())}</pre>")
            elif k < 0.94:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{self.main(self.words(2))}</td>" for _ in range(2)) + "</tr>" for _ in range(r.randint(1, 3))) + "</table>")
            elif k < 0.96:
                out.append(f"<figure><img src='x.png'><figcaption>{self.main(self.sentence(8))}</figcaption></figure>")
            elif k < 0.98:
                out.append(f"<div>{self.main(self.prose())}</div>")
            else:
                out.append(f"<section><p>{self.main(self.prose())}</p></section>")
        for k, p in ((self.ad, 0.2), (self.share, 0.12), (self.related, 0.1), (self.comments, 0.1), (self.form, 0.08), (self.notice, 0.08)):
            if r.random() < p:
                out.insert(r.randint(1, len(out)) if len(out) > 1 and k in (self.ad, self.notice, self.form) else len(out), ("</p>" if open_p else "") + k())
        return "".join(out)

    def ad(self) -> str:
        return self.wrap(self.r.choice(_ADS), self.r.choice([self.sentence(), self.say("ad"), self.say("ad") + " " + self.sentence(), f"<p>{self.prose()}</p>", f"<p>{self.long('ad')}</p>", self.link(self.sentence())]))

    def share(self) -> str:
        return self.wrap(self.r.choice(_SHARE), self.r.choice([self.say("share"), "".join(f"<li>{self.link(self.say('share'))}</li>" for _ in range(3))]))

    def related(self) -> str:
        inner = f"<h3>{self.say('more')}</h3>" if self.r.random() < 0.6 else ""
        inner += self.r.choice([self.menu(2), "".join(f"<p>{self.link(self.sentence(8))}</p>" for _ in range(3)), f"<p>{self.prose()}</p>", self.sentence()])
        return self.wrap(self.r.choice(_SIDE), inner)

    def comments(self) -> str:
        inner = f"<h3>{self.say('reply')}</h3>" if self.r.random() < 0.6 else ""
        for _ in range(self.r.randint(1, 4)):
            inner += self.wrap(self.r.choice(["div.comment", "li.comment", "div.reply", "article.comment", "div.comment-body", "p", "li", "div"]), self.r.choice(["", f"<b>{self.word()}</b> ", f"<p>{self.say('reply')}</p>"]) + self.r.choice([self.prose(), f"<p>{self.prose()}</p>"]))
        return self.wrap(self.r.choice(_COMMENTS), inner)

    def form(self) -> str:
        return self.wrap(self.r.choice(_FORM), self.r.choice(["", f"<label>{self.say('form')}</label>", f"<p>{self.sentence()}</p>", f"<p>{self.say('form')} {self.sentence()}</p>", f"<p>{self.long('form')}</p>"]) + "<input name='q'>" + self.r.choice([self.say("form"), f"<button>{self.say('form')}</button>"]))

    def notice(self) -> str:
        kind = self.r.choice(_NOTICE) if self.r.random() < 0.8 else self.r.choice(["div", "section", "p", f"div.{self.word()}"])
        inner = [f"<p>{self.long('notice')}</p>", self.long("notice"), f"<p>{self.say('notice')} {self.long('notice')}</p>"]
        if kind in _NOTICE:
            inner += [self.say("notice"), f"<p>{self.say('notice')} {self.sentence()}</p>", self.sentence(), f"<p>{self.prose()}</p>"]
        return self.wrap(kind, self.r.choice(inner) + self.r.choice(["", "<button>OK</button>", self.link("OK")]))

    def html(self) -> str:
        r = self.r
        if r.random() < 0.15:  # nothing but the article
            body = self.wrap(r.choice(_CONTENT), self.content()) if r.random() < 0.85 else self.content()
            return r.choice([body, f"<body>{body}</body>", f"<html><head><title>{self.words(3)}</title></head><body>{body}</body></html>"])
        top = []
        if r.random() < 0.6:
            top.append(self.wrap(r.choice(_HEAD), r.choice([self.link(self.words(2)), f"<h1>{self.words(2)}</h1>", f"<p>{self.sentence(6)}</p>", self.menu(), f"<div>{self.words(2)}</div>" + self.wrap(r.choice(_NAV), self.menu())])))
        if r.random() < 0.8:
            top.append(self.wrap(r.choice(_NAV), self.menu()))
        for k, p in ((self.notice, 0.3), (self.ad, 0.4), (self.form, 0.2)):
            if r.random() < p:
                top.append(k())
        r.shuffle(top)
        middle = self.wrap(r.choice(_CONTENT), self.content()) if r.random() < 0.97 else self.content()
        if r.random() < 0.25:
            middle = self.wrap(r.choice(["main", "div.container", "div.wrapper", "div#page", "section"]), middle + (self.related() if r.random() < 0.3 else ""))
        bottom = [k() for k, p in ((self.related, 0.4), (self.comments, 0.35), (self.ad, 0.2), (self.form, 0.15), (self.share, 0.15), (self.notice, 0.15)) if r.random() < p]
        r.shuffle(bottom)
        if r.random() < 0.15:
            middle = "".join(bottom[:1]) + middle
            bottom = bottom[1:]
        if r.random() < 0.85:
            bottom.append(self.wrap(r.choice(_FOOT), r.choice([self.say("foot"), self.say("foot") + " " + self.sentence(), self.menu(), f"<p>{self.prose()}</p>", f"<p>{self.long('foot')}</p>", self.sentence(), self.say("foot") + " · " + self.prose(), f"<p>{self.say('foot')}</p>" + self.menu()])))
        return f"<html><head><title>{self.words(3)}</title></head><body>{''.join(top)}{middle}{''.join(bottom)}" + r.choice(["</body></html>", ""])


def labelled_pages(n: int = 1500, seed: int = 20) -> list[list[Block]]:
    """n made-up pages as blocks with labels."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        blocks = leaf_blocks(_Page(rng).html())
        for b in blocks:
            b.label = int(MARK in b.text)
            b.text = b.text.replace(MARK, "")
        out.append([b for b in blocks if b.text])
    return out
