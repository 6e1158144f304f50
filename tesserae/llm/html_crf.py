"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is read by a tolerant tag scanner (raw-text elements, comments, quoted and bare attributes, unclosed
and implied end tags, truncated ends). A leaf block is a maximal run of text between boundaries of
block-level elements, with the state that the elements around it lead to: equal chains give equal states,
so a block costs the same however deep it stands. Its features are ancestor tags, role words in ancestors' class, id
and role attributes, the innermost ancestor that says content or boilerplate, and figures of its text
(length, share of links, punctuation, marks such as a copyright sign). Two labels, main text and the
rest, form the chain; Viterbi decodes it, and main blocks are joined in page order.

The field is trained here on labelled pages from a generator (`labelled_pages`): page designs with
menus, headers, footers, sidebars, notices, adverts, forms, reader comments, tables and articles, in
random order and nesting, with blocks of known labels. Training maximises the conditional likelihood by
gradient descent on the driver, once in a process, with fixed seeds; the weights (some KB) are broadcast.

Scripts, styles, templates, frames, drawings, selections, text areas, the head and comments of the markup
are no blocks; formulas, objects and noscript elements are offered to the field like any text. Character
references are decoded, white space (also a line break) inside a block becomes one space. Nulls and empty pages give an
empty text. Repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import html
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import roomy, small_batches

#: What follows a tag's name: quotes count only where a value starts; one that never ends is text of the value.
_INSIDE = r"""(?>(?:[^>=]|=\s*(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*)?)*)"""
_TOKEN = re.compile(rf"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(?P<raw>script|style|template|svg|iframe|textarea|select)(?![a-z0-9:-]){_INSIDE}(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<more>{_INSIDE})(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S | re.I)
_TO_THE_END = {"script", "style", "iframe", "textarea"}  # without an end tag these take the rest of a page
_ATTRIBUTE = re.compile(r"""([^\s=/>]+)\s*=\s*("[^"]*"|'[^']*'|[^\s>]*)""")
_NAMED = {"class", "id", "role", "aria-label", "itemprop"}
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_VOID = {"br", "hr", "img", "input", "meta", "link", "wbr", "area", "base", "col", "embed", "source", "track", "param"}
_BLOCK = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html hr legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul button label noscript".split())
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
_ENDS_P = _BLOCK - {"button", "label", "body", "html", "head", "option", "optgroup", "caption", "legend", "summary"}
_LIST_SCOPE = {"ul", "ol", "dl", "table", "menu"}
_MARKS = ("nav header footer aside form article main section ul ol li table td th blockquote pre h1 h2 h3 h4 h5 h6 p div figure figcaption button label dl a fieldset details address title noscript".split())
_BAD = {
    "menu": "nav navbar menu navigation breadcrumb breadcrumbs tabs toolbar topbar navlinks sitemap skip pagination pager paging toc",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promoted promotion banner dfp adsense",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay toast disclaimer warning paywall notification",
    "comment": "comment comments commentlist reply replies respond disqus discussion reader readers feedback responses",
    "side": "sidebar side aside widget widgets related recommended recommendations popular trending more rail also teaser teasers",
    "foot": "footer foot copyright legal colophon credits bottom",
    "head": "header masthead top logo brand branding site tagline",
    "social": "share sharing social follow twitter facebook tweet like likes",
    "form": "form search login signin signup subscribe newsletter register input field",
}
_GOOD = {"body": "content article post entry story text main maincontent body page prose copy", "lead": "title headline heading lead summary abstract intro"}
_ROLE = {w: (0, k) for k, v in _BAD.items() for w in v.split()} | {w: (1, k) for k, v in _GOOD.items() for w in v.split()}
_BAD_TAGS = {"nav", "footer", "aside", "form", "button", "label", "fieldset"}
_TAG_SET = set(_MARKS)


_NAMES: dict[str, int] = {}


def _feature(name: str) -> int:
    return _NAMES.setdefault(name, len(_NAMES))


def _vocabulary() -> None:
    """All features in a fixed order, the same in every process."""
    for name in ("bias", "first", "early", "late", "period", "copyright", "short caps", "digits", "inner good", "inner bad", "no role", "in body only", "same place", "comma", "outer header"):
        _feature(name)
    for prefix, names in (("tag", _MARKS), ("parent", _MARKS), ("bad", _BAD), ("good", _GOOD), ("inner", [*_BAD, *_GOOD, *_BAD_TAGS, "article", "main", "header"]), ("words", range(7)), ("links", range(4)), ("both", [f"{i}{j}" for i in range(7) for j in range(4)])):
        for n in names:
            _feature(f"{prefix} {n}")


_vocabulary()


class _State:
    """What the elements around a block say: their features, the innermost role, and what later elements need to know."""

    __slots__ = ("key", "features", "in_head", "after")

    def __init__(self, key: tuple):
        names, inner, header, main, plain, tag = self.key = key
        self.in_head = "in head" in names
        own = set(names) - {"in head"}
        own.add("no role" if inner is None else "inner good" if inner[0] else "inner bad")
        if inner is not None:
            own.add(f"inner {inner[1]}")
        if tag in _TAG_SET:
            own.add(f"parent {tag}")
        if header and "tag article" not in names:
            own.add("outer header")
        if plain:
            own.add("in body only")
        self.features = tuple(_NAMES[n] for n in sorted(own) if n in _NAMES)
        self.after: dict[tuple, _State] = {}

    def within(self, tag: str, roles: tuple) -> _State:
        """The state inside an element with these role words."""
        found = self.after.get((tag, roles))
        if found is None:
            names, inner, header, main, plain, _ = self.key
            more = {f"{'good' if good else 'bad'} {kind}" for good, kind in roles}
            if tag in _TAG_SET:
                more.add(f"tag {tag}")
            if tag == "head":
                more.add("in head")
            if tag in _BAD_TAGS or tag in ("article", "main", "header"):
                inner = (tag in ("article", "main"), tag)
            if roles:
                inner = next((r for r in roles if not r[0]), roles[0])
            header = header or (tag == "header" and not main)
            key = (names | more, inner, header, main or tag == "main", plain and tag in ("html", "body", "p", "div", "a"), tag)
            found = _states.get(key)
            if found is None:
                if len(_states) >= _MOST_STATES:  # bounded: later pages start anew
                    _states.clear()
                found = _states[key] = _State(key)
            self.after[tag, roles] = found
        return found


_MOST_STATES = 65536
_states: dict[tuple, _State] = {}


def _start() -> _State:
    key = (frozenset(), None, False, False, True, "")
    if key not in _states:
        _states[key] = _State(key)
    return _states[key]


def blocks(page: str) -> list[tuple[str, _State, int]]:
    """Leaf blocks in page order: (text, state, characters inside links)."""
    out: list[tuple[str, _State, int]] = []
    stack: list[tuple[str, _State]] = [("", _start())]
    held: dict[str, int] = {}  # open elements of each name
    run: list[str] = []
    links = 0

    def flush():
        nonlocal links
        if run:
            state = stack[-1][1]
            if not state.in_head:
                text = _SPACE.sub(" ", html.unescape("".join(run))).strip()
                if text:
                    out.append((text, state, links))
            run.clear()
        links = 0

    def close(names: set, stop: set):
        if not any(held.get(n) for n in names):
            return
        for i in range(len(stack) - 1, 0, -1):
            tag = stack[i][0]
            if tag in names:
                flush()
                for t, _ in stack[i:]:
                    held[t] -= 1
                del stack[i:]
                return
            if tag in stop:
                return

    def text(piece: str):
        nonlocal links
        run.append(piece)
        if held.get("a"):
            links += len(piece)

    at, size = 0, len(page)
    while at < size:
        found = _TOKEN.search(page, at)
        if not found:
            piece = page[at:]
            cut = piece.rfind("<")
            if cut >= 0 and re.match(r"</?[a-zA-Z]", piece[cut:]):
                piece = piece[:cut]  # the page ends inside a tag
            text(piece)
            break
        if found.start() > at:
            text(page[at : found.start()])
        at = found.end()
        raw, tag = found.group("raw"), found.group("tag")
        if raw:  # up to the end tag this is not page text
            raw = raw.lower()
            if raw == "svg" and found.group(0).endswith("/>"):
                continue
            end = _ENDS[raw].search(page, at)
            at = end.end() if end else size if raw in _TO_THE_END else at
            continue
        if not tag:
            continue
        tag = tag.lower()
        if tag == "br":
            run.append(" ")
            continue
        block = tag in _BLOCK
        if found.group("end"):
            if block or tag == "a":
                close({tag}, set() if block else _BLOCK)
            continue
        if block:
            flush()
            if tag in _ENDS_P:
                close({"p"}, _BLOCK - {"p"})
            if tag in _CLOSES:
                close(_CLOSES[tag], _LIST_SCOPE if tag not in ("tr", "td", "th") else {"table"})
        if tag in _VOID or (not block and tag != "a"):
            continue
        more = found.group("more")
        roles = ()
        if "=" in more:
            words = (w for name, value in _ATTRIBUTE.findall(more) if name.lower() in _NAMED for w in _WORD.findall(value.lower()))
            roles = tuple(_ROLE[w] for w in words if w in _ROLE)
        stack.append((tag, stack[-1][1].within(tag, roles)))
        held[tag] = held.get(tag, 0) + 1
    flush()
    return out


_ENDS = {n: re.compile(rf"</{n}\b[^>]*(?:>|\Z)", re.I) for n in ("script", "style", "template", "svg", "iframe", "textarea", "select")}


def block_features(found: list[tuple[str, _State, int]]) -> list[tuple[int, ...]]:
    out = []
    for i, (text, state, links) in enumerate(found):
        words = text.count(" ") + 1
        size = 0 if words <= 1 else 1 if words <= 3 else 2 if words <= 7 else 3 if words <= 15 else 4 if words <= 30 else 5 if words <= 80 else 6
        share = links / max(len(text), 1)
        link = 0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.8 else 3
        names = ["bias", f"words {size}", f"links {link}", f"both {size}{link}"]
        if i == 0:
            names.append("first")
        names.append("early" if i < len(found) / 3 else "late" if i > len(found) * 2 / 3 else "bias")
        if text[-1] in ".!?…":
            names.append("period")
        if "," in text:
            names.append("comma")
        if "©" in text or "(c)" in text[:12].lower():
            names.append("copyright")
        if size < 3 and text.isupper():
            names.append("short caps")
        if any(c.isdigit() for c in text[:80]):
            names.append("digits")
        if i and found[i - 1][1].key == state.key:
            names.append("same place")
        out.append((*state.features, *{_NAMES[n] for n in names}))
    return out


class Field:
    """Weights of a two-label linear chain: emission (features x 2), transition (2 x 2), start (2)."""

    def __init__(self):
        self.emission = np.zeros((len(_NAMES), 2))
        self.transition = np.zeros((2, 2))
        self.start = np.zeros(2)

    def emissions(self, rows: list[tuple[int, ...]]) -> np.ndarray:
        sizes = np.array([len(r) for r in rows])
        flat = np.fromiter((i for r in rows for i in r), np.int64, int(sizes.sum()))
        return np.add.reduceat(self.emission[flat], np.cumsum(sizes) - sizes, axis=0)

    def viterbi(self, rows: list[tuple[int, ...]]) -> list[int]:
        """The most likely labels (1: main text)."""
        if not rows:
            return []
        e = self.emissions(rows).tolist()
        (t00, t01), (t10, t11) = self.transition.tolist()
        a, b = e[0][0] + float(self.start[0]), e[0][1] + float(self.start[1])
        back = []
        for x, y in e[1:]:
            stay0, stay1 = a + t00 >= b + t10, b + t11 >= a + t01
            back.append((0 if stay0 else 1, 1 if stay1 else 0))
            a, b = (a + t00 if stay0 else b + t10) + x, (b + t11 if stay1 else a + t01) + y
        label = 1 if b > a else 0
        path = [label]
        for step in reversed(back):
            label = step[label]
            path.append(label)
        return path[::-1]

    def learn(self, pages: list[tuple[list[tuple[int, ...]], list[int]]], rounds: int = 150, step: float = 0.3, decay: float = 1e-3) -> Field:
        """Maximum conditional likelihood by AdaGrad; forward and backward sums run over all pages at once."""
        pages = [p for p in pages if p[0]]
        longest, count = max(len(p[1]) for p in pages), len(pages)
        length = np.array([len(p[1]) for p in pages])
        gold = np.zeros((count, longest), np.int64)
        for i, (_, labels) in enumerate(pages):
            gold[i, : len(labels)] = labels
        live = np.arange(longest) < length[:, None]
        sizes = np.array([len(r) for p in pages for r in p[0]])
        flat = np.fromiter((i for p in pages for r in p[0] for i in r), np.int64, int(sizes.sum()))
        first = np.cumsum(sizes) - sizes
        token = np.repeat(np.arange(len(sizes)), sizes)
        sums = [np.full(x.shape, 1e-6) for x in (self.emission, self.transition, self.start)]
        truth = np.eye(2)[gold]
        for _ in range(rounds):
            e = np.zeros((count, longest, 2))
            e[live] = np.add.reduceat(self.emission[flat], first, axis=0)
            forward, backward = np.zeros_like(e), np.zeros_like(e)
            forward[:, 0] = e[:, 0] + self.start
            for t in range(1, longest):
                step_in = forward[:, t - 1, :, None] + self.transition
                forward[:, t] = np.where(live[:, t, None], np.logaddexp(step_in[:, 0], step_in[:, 1]) + e[:, t], forward[:, t - 1])
            for t in range(longest - 2, -1, -1):
                step_out = self.transition + (e[:, t + 1] + backward[:, t + 1])[:, None, :]
                backward[:, t] = np.where(live[:, t + 1, None], np.logaddexp(step_out[:, :, 0], step_out[:, :, 1]), 0)
            total = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
            seen = np.exp(forward + backward - total[:, None, None])
            gap = (seen - truth)[live] / count
            pair = np.exp(forward[:, :-1, :, None] + self.transition + (e[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None])
            pair = (pair - truth[:, :-1, :, None] * truth[:, 1:, None, :])[live[:, 1:]].sum(0) / count
            emission = np.stack([np.bincount(flat, weights=gap[token, k], minlength=len(self.emission)) for k in (0, 1)], 1)
            for i, (name, g) in enumerate((("emission", emission), ("transition", pair), ("start", (seen - truth)[:, 0].mean(0)))):
                w = getattr(self, name)
                g = g + decay * w
                sums[i] += g**2
                setattr(self, name, w - step * g / np.sqrt(sums[i]))
        return self


def labelled_pages(count: int = 500, seed: int = 3):
    """Pages with known main blocks: (html, list of the main blocks' texts)."""
    rng = random.Random(seed)
    syllables = "an er tion le mo ra si ti ve no ka lu pe do chi sta ble ou ing the ment den ura ble".split()

    def word():
        return "".join(rng.choices(syllables, k=rng.choice((1, 1, 2, 2, 3))))

    def phrase(a, b):
        return " ".join(word() for _ in range(rng.randint(a, b)))

    def sentence(a=4, b=18):
        return phrase(a, b).capitalize() + rng.choice("....!?,")

    def prose():
        return " ".join(sentence() for _ in range(rng.choice((1, 1, 2, 3, 5, 9))))

    def attribute(kinds, extra=""):
        if rng.random() < 0.12:
            return ""
        name = rng.choice([w for k in kinds for w in (_BAD | _GOOD)[k].split()])
        value = rng.choice((name, f"{name}-{rng.choice(('box', 'wrap', 'list', 'item', 'area'))}", f"{word()} {name}", f"{rng.choice(('site', 'page', 'x'))}-{name}"))
        return f' {rng.choice(("class", "class", "id"))}="{value}"{extra}'

    def links(n):
        style = rng.random()
        items = [f'<a href="/{word()}">{phrase(1, 4)}</a>' for _ in range(n)]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if style < 0.7 else " | ".join(items) if style < 0.85 else "".join(f"<div>{x}</div>" for x in items)

    def short():
        return rng.choice((phrase(1, 5), sentence(), sentence() + " " + sentence()))

    def menu():
        return f"<nav{attribute(['menu']) if rng.random() < 0.5 else ''}>{links(rng.randint(3, 9))}</nav>" if rng.random() < 0.6 else f"<div{attribute(['menu'], ' ') or ' class=menu'}>{links(rng.randint(3, 9))}</div>"

    def boilerplate():
        kind = rng.choice(("ad", "ad", "notice", "comment", "side", "social", "form", "menu", "head"))
        tag = rng.choice({"side": ("aside", "aside", "div"), "form": ("form", "form", "div"), "notice": ("div", "section", "div", "noscript"), "comment": ("section", "div", "ol"), "head": ("header",)}.get(kind, ("div", "section", "div")))
        role = attribute([kind])
        if tag in ("div", "section", "ol") and not role:
            role = f' class="{(_BAD[kind]).split()[0]}"'
        if kind == "menu":
            return menu()
        body = {
            "ad": lambda: rng.choice((short(), f"<p>{prose()}</p>", f"<a href=x>{short()}</a>", prose())),
            "notice": lambda: f"<p>{prose()}</p><button>{phrase(1, 2)}</button>" if rng.random() < 0.5 else prose(),
            "comment": lambda: f"<h3>{phrase(1, 3)}</h3>" * (rng.random() < 0.6) + "".join(f"<{t}{rng.choice(('', ' class=comment'))}><b>{phrase(1, 2)}</b> <p>{prose()}</p></{t}>" for t in [rng.choice(("div", "li", "article"))] for _ in range(rng.randint(1, 5))),
            "side": lambda: f"<h3>{phrase(1, 4)}</h3>" + rng.choice((links(rng.randint(2, 6)), f"<p>{prose()}</p>", f"<div>{short()}</div>")),
            "social": lambda: links(rng.randint(2, 4)),
            "form": lambda: f"<label>{phrase(1, 3)}</label><input name=q><button>{phrase(1, 2)}</button>" + f"<p>{short()}</p>" * (rng.random() < 0.4),
            "head": lambda: rng.choice((f"<div>{phrase(1, 4)}</div>", f"<h2>{phrase(1, 4)}</h2><p>{short()}</p>")) + (menu() if rng.random() < 0.4 else ""),
        }[kind]()
        return f"<{tag}{role}>{body}</{tag}>"

    for _ in range(count):
        main: list[str] = []

        def keep(text, before="", after=""):
            main.append(text)
            return before + text + after

        def article():
            parts = []
            if rng.random() < 0.85:
                h = rng.choice(("h1", "h1", "h2"))
                parts.append(keep(phrase(2, 12), f"<{h}>", f"</{h}>"))
                if rng.random() < 0.15:
                    parts[-1] = f"<header>{parts[-1]}</header>"
            for _ in range(rng.choice((0, 1, 2, 3, 4, 6, 9, 14))):
                r = rng.random()
                if r < 0.7:
                    parts.append(keep(prose(), "<p>", rng.choice(("</p>", "</p>", ""))))
                elif r < 0.78:
                    h = rng.choice(("h2", "h3", "p><b"))
                    parts.append(keep(phrase(1, 8) + rng.choice(("", ".")), f"<{h}>", "<br>" if h == "p><b" else f"</{h}>"))
                elif r < 0.84:
                    parts.append("<ul>" + "".join(keep(short(), "<li>", "</li>") for _ in range(rng.randint(2, 5))) + "</ul>")
                elif r < 0.88:
                    parts.append("<blockquote>" + keep(prose(), "<p>", "</p>") + "</blockquote>")
                elif r < 0.91:
                    parts.append("<table>" + "".join("<tr>" + keep(phrase(1, 4), "<td>", "</td>") + keep(phrase(1, 4), "<td>", "</td>") + "</tr>" for _ in range(rng.randint(1, 3))) + "</table>")
                elif r < 0.94:
                    parts.append("<figure><img src=x>" + keep(short(), "<figcaption>", "</figcaption>") + "</figure>")
                elif r < 0.95:
                    parts.append("<pre>" + keep(phrase(3, 9)) + "</pre>")
                elif r < 0.96:
                    parts.append("<noscript>" + keep(prose(), "<p>", "</p>") + "</noscript>")
                else:
                    parts.append(boilerplate())
            if rng.random() < 0.25:
                parts.append(boilerplate())
            return "".join(parts)

        r = rng.random()
        opening, closing = ("", "") if r < 0.08 else ("<article>", "</article>") if r < 0.47 else ("<main>", "</main>") if r < 0.6 else ("<main><article>", "</article></main>") if r < 0.7 else (f"<div{attribute(['body']) or ' class=content'}>", "</div>")
        if rng.random() < 0.15:
            opening, closing = f"<div{attribute(['body'])}>" + opening, closing + "</div>"
        before = [menu()] * (rng.random() < 0.7) + [boilerplate() for _ in range(rng.choice((0, 1, 1, 2, 3)))]
        if rng.random() < 0.4:
            t = rng.choice(("div", "h1", "p", "span"))
            before.insert(0, f"<header{attribute(['head'])}><{t}>{phrase(1, 4)}</{t}>{menu() if rng.random() < 0.5 else ''}</header>")
        after = [boilerplate() for _ in range(rng.choice((0, 0, 1, 2, 3)))]
        if rng.random() < 0.85:
            after.append(rng.choice((f"<footer>&copy; {phrase(1, 6)}</footer>", f"<footer><p>{prose()}</p>{links(3)}</footer>", f"<div class=footer>{short()}</div>", f"<footer>&copy; {word()} &middot; {prose()}</footer>")))
        head = f"<!DOCTYPE html><html><head><title>{phrase(2, 9)}</title></head><body>"
        page = head + "".join(before) + opening + article() + closing + "".join(after) + rng.choice(("</body></html>", ""))
        yield page, main


def training_set(count: int = 500, seed: int = 3) -> list[tuple[list, list[int]]]:
    out = []
    for page, main in labelled_pages(count, seed):
        found = blocks(page)
        left = [_SPACE.sub(" ", t).strip() for t in main]
        labels = []
        for text, _, _ in found:
            hit = bool(left) and text == left[0]
            labels.append(int(hit))
            if hit:
                left.pop(0)
        if left:
            continue  # a short heading equals a block before it; the page has no sure labels
        out.append((block_features(found), labels))
    return out


@lru_cache(maxsize=1)
def trained() -> Field:
    return Field().learn(training_set())


def extract(page: str, field: Field) -> tuple[str, int, int]:
    """(main text, blocks, main blocks)"""
    found = blocks(page)
    labels = field.viterbi(block_features(found))
    main = [b[0] for b, y in zip(found, labels, strict=True) if y]
    return "\n".join(main), len(found), len(main)


def _run(model):
    def run(batches):
        field = model.value
        for b in batches:
            rows = [extract(x, field) if x else ("", 0, 0) for x in b.column(2).to_pylist()]
            text = [r[0] for r in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64()), *(pa.array([r[k] for r in rows], pa.int32()) for k in (1, 2))], ["page_id", "url", "text", "n_chars", "n_blocks", "n_main"])

    return run


def html_crf(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks, n_main) for every page; see the module."""
    spark = pages.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(trained())
    return pages.select("page_id", "url", "html").mapInArrow(roomy(_run(model)), "page_id long, url string, text string, n_chars long, n_blocks int, n_main int")
