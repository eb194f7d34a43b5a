"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the document tree."""

from __future__ import annotations

import html
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Pages sampled for training, characters read of each, and labelled variants made of each.
SAMPLE, EXCERPT, VARIANTS = 160, 20_000, 4
EPOCHS, RATE, PENALTY = 150, 0.1, 1e-4

# Fixed values of the markup language.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split())
# Formulas stand in their sentence; annotations repeat them in another notation.
INLINE |= set("math menclose mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("script style template noscript iframe object svg title textarea select canvas audio video annotation annotation-xml".split())
RAW = set("script style textarea title".split())
# What cannot stand in a list of choices: its start ends one that is left open.
SECTIONS = set("article aside body footer form header main nav section".split())
# A start tag on the left ends an open element on the right.
# The element that carries labels in made pages; it leaves no trace in features.
LABEL = "x-label"
_NONE: frozenset = frozenset()
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^<>\"'])*)>|<[!?][^<>]*>", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|data-y)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_NAME = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


class Block:
    """Text, nearest block element, all of them and the words of their class, id and role, share of linked text."""

    __slots__ = ("text", "tag", "tags", "names", "linked", "label")

    def __init__(self, text, tag, tags, names, linked, label):
        self.text, self.tag, self.tags, self.names, self.linked, self.label = text, tag, tags, names, linked, label


def blocks(page: str) -> list[Block]:
    """Leaf blocks with text, in page order: what stands between two tags of block elements, white space made single.

    Inline tags do not end a block, ``br`` counts as white space. What scripts, styles and other elements without prose hold
    is left out; such an element, left open, ends with its parent, a list of choices also where a section begins. Scripts, styles,
    titles and text fields run to their end tag or the end of the page. A head needs no end: what it may hold has no prose.
    Unclosed elements end with their parents, stray end tags are ignored.
    """
    out: list[Block] = []
    # Open block elements; sets are shared with the parent where nothing is new, so deep nesting costs little.
    stack: list[tuple[str, frozenset, frozenset, str]] = []
    opened: Counter = Counter()
    parts: list[str] = []
    linked, in_link, hidden = 0, False, ""
    # Elements opened within the hidden one.
    within: Counter = Counter()

    def flush():
        nonlocal linked
        text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
        if text:
            out.append(Block(text, *(stack[-1][:3] if stack else ("", _NONE, _NONE)), min(1.0, linked / len(text)), stack[-1][3] if stack else ""))
        parts.clear()
        linked = 0

    def close() -> str:
        tag = stack.pop()[0]
        opened[tag] -= 1
        return tag

    at, size = 0, len(page)
    while at < size:
        found = _TOKEN.search(page, at)
        piece = page[at : found.start() if found else size]
        if piece and not hidden:
            parts.append(piece)
            linked += len(piece) * in_link
        if not found:
            break
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if hidden and found[1]:
            if within[tag]:
                within[tag] -= 1
                continue
            if tag != hidden and not opened[tag] and not (tag == "math" and hidden.startswith("annotation")):
                continue
            ended, hidden = hidden, ""
            if tag == ended:
                continue
        if found[1]:
            if tag == "a":
                in_link = False
            elif tag not in INLINE and opened[tag]:
                flush()
                while opened[tag] and close() != tag:
                    pass
            elif tag not in INLINE:
                flush()
            continue
        if hidden and found[3].endswith("/"):
            continue
        if tag in RAW:  # no tags inside: go to its end
            end = re.compile(rf"</{tag}(?:[\s/][^>]*)?>", re.I).search(page, at)
            at = end.end() if end else size
            if not hidden:
                parts.append(" ")
            continue
        if hidden == "select" and tag in SECTIONS:
            hidden = ""
        if hidden:
            within[tag] += tag not in VOID
        elif tag in HIDDEN:
            if not found[3].endswith("/"):
                if not tag.startswith("annotation"):
                    flush()
                hidden = tag
                within.clear()
        elif tag == "a":
            in_link = True
        elif tag == "br":
            parts.append(" ")
        elif tag not in INLINE:
            flush()
            if tag in VOID or tag == "head":
                continue
            closed = CLOSES.get(tag, set()) | {"p"}
            while stack and stack[-1][0] in closed:
                close()
            values = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(found[3])}
            names = set(_NAME.findall(" ".join(values.get(k, "") for k in ("class", "id", "role")).lower()))
            _, tags, held, label = stack[-1] if stack else ("", _NONE, _NONE, "")
            if tag != LABEL:
                tags, held = (tags if tag in tags else tags | {tag}), (held if names <= held else held | names)
            stack.append((tag, tags, held, values.get("data-y", label)))
            opened[tag] += 1
    flush()
    return out


# ---- features ----

_END = re.compile(r"[.!?…:\"'”»)]$")
_HINTS = {
    "copyright": re.compile(r"©|copyright|all rights reserved", re.I),
    "notice": re.compile(r"\b(cookies?|privacy|consent|subscribe|newsletter|sign (?:in|up)|log ?in|register|accept)\b", re.I),
    "reply": re.compile(r"\b(reply|replies|comments?|posted|says|wrote|said)\b", re.I),
    "share": re.compile(r"\b(share|tweet|follow us|related|read more|advertisement|sponsored|promoted)\b", re.I),
}


def features(block: Block, place: float) -> list[str]:
    words = block.text.count(" ") + 1
    out = ["bias", f"tag={block.tag}", f"words={min(words, 400).bit_length()}", f"link={int(block.linked * 4)}"]
    out += [f"in={t}" for t in block.tags]
    out += [f"name={n}" for n in block.names]
    out.append("end=" + str(bool(_END.search(block.text))))
    out.append(f"commas={min(block.text.count(','), 3)}")
    out.append("place=" + ("first" if place < 0.1 else "last" if place > 0.9 else "inside"))
    out += [f"hint={k}" for k, p in _HINTS.items() if words < 60 and p.search(block.text)]
    return out


def page_features(found: list[Block]) -> list[list[str]]:
    return [features(b, k / max(1, len(found) - 1)) for k, b in enumerate(found)]


# ---- the conditional random field: states 0 (other) and 1 (main text) ----


class Field:
    """Weights of features (per state) and of transitions."""

    def __init__(self, weights: dict[str, tuple[float, float]], transitions, start):
        self.weights, self.transitions, self.start = weights, transitions, start

    def decode(self, sequence: list[list[str]]) -> list[int]:
        """The likeliest states, by Viterbi; a tie goes to state 0."""
        if not sequence:
            return []
        (t00, t01), (t10, t11) = self.transitions
        back, score = [], None
        for names in sequence:
            e0 = e1 = 0.0
            for n in names:
                w = self.weights.get(n)
                if w:
                    e0 += w[0]
                    e1 += w[1]
            if score is None:
                score = (self.start[0] + e0, self.start[1] + e1)
                continue
            a, b = score
            from0, from1 = int(b + t10 > a + t00), int(b + t11 > a + t01)
            back.append((from0, from1))
            score = ((b + t10 if from0 else a + t00) + e0, (b + t11 if from1 else a + t01) + e1)
        states = [int(score[1] > score[0])]
        for pointers in reversed(back):
            states.append(pointers[states[-1]])
        return states[::-1]


def fit(sequences: list[tuple[list[list[str]], list[int]]]) -> Field:
    """Maximum likelihood with an L2 penalty by Adam; all sequences are run through forward-backward side by side."""
    names = sorted({n for xs, _ in sequences for x in xs for n in x})
    if not names:
        return Field({}, ((0.0, 0.0), (0.0, 0.0)), (0.0, 0.0))
    number = {n: k for k, n in enumerate(names)}
    count, longest = len(sequences), max(len(ys) for _, ys in sequences)
    gold = np.zeros((count, longest), np.int64)
    mask = np.zeros((count, longest), bool)
    spot, feature = [], []
    for s, (xs, ys) in enumerate(sequences):
        gold[s, : len(ys)], mask[s, : len(ys)] = ys, True
        for t, x in enumerate(xs):
            spot += [s * longest + t] * len(x)
            feature += [number[n] for n in x]
    spot, feature = np.array(spot), np.array(feature)
    w, t, b = np.zeros((len(names), 2)), np.zeros((2, 2)), np.zeros(2)
    hot = np.eye(2)[gold] * mask[:, :, None]
    pair_mask = mask[:, 1:]
    gold_pairs = np.einsum("sti,stj->ij", hot[:, :-1] * pair_mask[:, :, None], hot[:, 1:])
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, t, b)]
    for epoch in range(1, EPOCHS + 1):
        emission = np.stack([np.bincount(spot, w[feature, k], count * longest).reshape(count, longest) for k in (0, 1)], axis=2)
        alpha, beta = np.zeros((count, longest, 2)), np.zeros((count, longest, 2))
        alpha[:, 0] = b + emission[:, 0]
        for k in range(1, longest):
            step = np.logaddexp.reduce(alpha[:, k - 1, :, None] + t, axis=1) + emission[:, k]
            alpha[:, k] = np.where(mask[:, k, None], step, alpha[:, k - 1])
        for k in range(longest - 2, -1, -1):
            step = np.logaddexp.reduce(t + (emission[:, k + 1] + beta[:, k + 1])[:, None, :], axis=2)
            beta[:, k] = np.where(mask[:, k + 1, None], step, 0.0)
        total = np.logaddexp.reduce(alpha[:, -1], axis=1)
        single = np.exp(alpha + beta - total[:, None, None]) * mask[:, :, None]
        pairs = np.exp(alpha[:, :-1, :, None] + t + (emission + beta)[:, 1:, None, :] - total[:, None, None, None]) * pair_mask[:, :, None, None]
        wrong = (hot - single).reshape(-1, 2)
        grads = [
            np.stack([np.bincount(feature, wrong[spot, k], len(names)) for k in (0, 1)], axis=1) / count - PENALTY * w,
            (gold_pairs - pairs.sum(axis=(0, 1))) / count - PENALTY * t,
            (hot[:, 0] - single[:, 0]).sum(axis=0) / count,
        ]
        for p, g, m in zip((w, t, b), grads, moments, strict=True):
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.999 * m[1] + 0.001 * g * g
            p += RATE * (m[0] / (1 - 0.9**epoch)) / (np.sqrt(m[1] / (1 - 0.999**epoch)) + 1e-8)
    weights = {n: (float(w[k, 0]), float(w[k, 1])) for n, k in number.items()}
    return Field(weights, tuple(map(tuple, t.tolist())), tuple(b.tolist()))


# ---- labelled pages ----

# Names under which pages keep their main text and everything else; one is drawn for each made page.
_MAIN = ["<article>", "<main>", '<main><article class="post">', '<div class="content">', '<div id="main-content">', '<div class="post entry">', '<div class="article body">', '<section class="story text">', '<div role="main">', "<article><div>"]
_BEFORE = [
    '<header class="site header"><h1>{short}</h1><p>{short}</p></header>', "<header><h1>{short}</h1></header>", "<header><div>{short}</div><nav><ul>{links}</ul></nav></header>", "<nav><ul>{links}</ul></nav>", '<div class="menu navigation"><ul>{links}</ul></div>',
    '<div class="cookie notice banner"><p>{long}</p><button>Accept</button></div>', '<div class="ad advert">{long}</div>', '<div id="breadcrumbs">{anchors}</div>',
    '<div role="banner">{short}</div>', '<form class="search"><label>Search</label><input><button>{short}</button></form>', '<div class="alert message popup"><p>{long}</p></div>',
]
_WITHIN = [
    '<div class="ad">{long}</div>', '<aside class="related"><h3>{short}</h3><ul>{links}</ul></aside>', '<div class="share social">{anchors}</div>',
    '<div class="newsletter signup"><form><p>{long}</p><input><button>{short}</button></form></div>', '<aside><p>{long}</p></aside>', '<div class="promo sponsored"><p>{long}</p></div>',
]
_AFTER = [
    '<section class="comments" id="comments"><h2>{short}</h2><div class="comment"><p>{long}</p></div><div class="comment reply"><p>{long}</p><p>{long}</p></div></section>',
    '<div id="disqus thread" class="discussion responses"><article class="comment"><p>{long}</p></article><p>{long}</p></div>',
    "<footer><p>{long}</p><ul>{links}</ul></footer>", "<footer>&copy; {short} &middot; {long}</footer>", '<aside class="sidebar widget"><h3>{short}</h3><p>{long}</p><ul>{links}</ul></aside>',
    '<div class="footer copyright bottom">{long}</div>', '<div class="related recommended more"><h3>{short}</h3><ul>{links}</ul></div>', '<div class="sidebar"><p>{long}</p></div>',
    '<form class="contact"><p>{long}</p><label>{short}</label></form>', '<div class="author bio tags meta"><p>{short}</p></div>', '<div class="modal overlay consent"><p>{long}</p></div>',
]
# Where no page of a table shows its main text by its markup, made pages are built around these.
_PLAIN = [
    ("The river and its mills", "For two hundred years the mills along the river ground the corn of the valley, and the millers, who lived above their wheels, knew every bend of it.", "When the railway came, flour could be had from the coast for less. One wheel after another stopped turning.", "Only the lowest mill still runs. Its owners, a couple from the town, open it on Sundays."),
    ("How to store apples", "Pick them dry, on a cool day, and handle them as little as you can.", "Lay them in a single layer, without touching, in a cellar that stays just above freezing; look through them every week, since one that rots will spoil its neighbours.", "Late sorts keep until spring. Early ones, however good, do not."),
    ("Results of the survey", "Of the 1,204 households that answered, a little under half said that they had changed their supplier in the last three years.", "Price was named most often, but not by everyone: older people, in particular, spoke of service.", "The next survey is planned for autumn, with more questions about heating."),
]
_DROP = set("nav footer aside form header".split())
_DROP_NAMES = set("ad ads advert comment comments sidebar menu footer nav cookie banner promo related share".split())


def seed_label(block: Block) -> int:
    """The label that markup gives away on pages with an article or main element: inside it, outside of asides."""
    inside = "article" in block.tags or "main" in block.tags
    return int(inside and not _DROP & block.tags and not _DROP_NAMES & block.names)


def labelled_variants(page: str, draw: random.Random) -> list[list[Block]]:
    """Made pages around the paragraphs of one whose markup shows its main text; labels are known by making."""
    found = blocks(page)
    main = [b for b in found if seed_label(b)]
    rest = [b.text for b in found if not seed_label(b)] or ["Home"]
    if not main:
        return []
    out = []
    for _ in range(VARIANTS):
        def fill(template, draw=draw):
            pick = lambda: html.escape(draw.choice(main).text if draw.random() < 0.5 else draw.choice(rest))
            anchor = lambda: f'<a href="#">{" ".join(pick().split()[: draw.randint(1, 4)])}</a>'
            return template.format(
                long=" ".join(pick().split()[: draw.randint(4, 60)]), short=" ".join(pick().split()[: draw.randint(1, 6)]),
                links="".join(f"<li>{anchor()}</li>" for _ in range(draw.randint(2, 7))), anchors=" | ".join(anchor() for _ in range(draw.randint(2, 5))),
            )

        some = lambda of, most: [fill(t) for t in draw.sample(of, draw.randint(0, most))]  # noqa: B023, E731
        body = []
        for b in main:
            tag = b.tag if b.tag in {"p", "h1", "h2", "h3", "li", "blockquote", "pre"} else "p"
            if tag == "li":
                body.append(f"<ul><li>{html.escape(b.text)}</li></ul>")
            elif draw.random() < 0.08:
                body.append(f"<blockquote><p>{html.escape(b.text)}</p></blockquote>")
            else:
                body.append(f"<{tag}>{html.escape(b.text)}</{tag}>")
        if draw.random() < 0.3:
            body.insert(draw.randint(0, len(body)), f"<h2>{fill('{short}')}</h2>")
        if draw.random() < 0.15:
            body.insert(draw.randint(0, len(body)), f"<ul><li>{fill('{long}')}</li><li>{fill('{short}')}</li></ul>")
        for extra in some(_WITHIN, 2):
            body.insert(draw.randint(0, len(body)), f'<{LABEL} data-y="0">{extra}</{LABEL}>')
        opened = draw.choice(_MAIN) if draw.random() < 0.9 else ""
        closing = "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", opened)))
        before, after = some(_BEFORE, 5), some(_AFTER, 5)
        zero = lambda parts: f'<{LABEL} data-y="0">{"".join(parts)}</{LABEL}>'
        tail = zero([after.pop()]) if after and draw.random() < 0.4 else ""
        page = f'<body>{zero(before)}{opened}<{LABEL} data-y="1">{"".join(body)}</{LABEL}>{tail}{closing}{zero(after)}</body>'
        variant = blocks(page)
        for b in variant:
            b.tag = b.tag if b.tag != LABEL else "body"
        out.append(variant)
    return out


def train(pages: list[str]) -> Field:
    """Fits the field to the pages as their markup labels them, and to made variants of each; without any such page, to
    variants of ``_PLAIN``."""
    draw = random.Random(7)
    if not any(seed_label(b) for page in pages for b in blocks(page)):
        pages = [f"<article><h1>{title}</h1>{''.join(f'<p>{p}</p>' for p in texts)}</article>" for title, *texts in _PLAIN] * 8
    sequences = []
    for page in pages:
        found = blocks(page)
        if any(seed_label(b) for b in found):
            sequences.append((page_features(found), [seed_label(b) for b in found]))
        for variant in labelled_variants(page, draw):
            sequences.append((page_features(variant), [int(b.label == "1") for b in variant]))
    return fit(sequences)


def main_text(page: str | None, field: Field) -> str:
    """Blocks that the field takes for main text, joined by an empty line."""
    found = blocks(page or "")
    return "\n\n".join(b.text for b, y in zip(found, field.decode(page_features(found)), strict=True) if y)


def _extract(position: int, field: Field):
    def run(batches):
        for batch in batches:
            texts = [main_text(p, field) for p in batch.column(position).to_pylist()]
            columns = [*batch.columns[:position], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:position], "text", "n_chars"])

    return run


def extract(pages: DataFrame, carry: tuple = ("page_id", "url")) -> DataFrame:
    """(*carry, text, n_chars) of every row of ``pages`` (html, *carry).

    The field is trained on a bounded sample of pages that have an article or main element, taken in hash order of
    html; without any, on made pages alone. A null or empty page has an empty text. Rows repeat as they come.
    """
    marked = pages.where(F.col("html").rlike("(?i)<(article|main)[ >]")).select(F.xxhash64("html").alias("h"), F.substring("html", 1, EXCERPT).alias("page"))
    # Hashes decide first, so that few pages travel however many tasks there are; copies of a page count once.
    smallest = [r.h for r in marked.select("h").distinct().orderBy("h").limit(SAMPLE).collect()]
    chosen = marked.where(F.col("h") <= (smallest[-1] if smallest else 0)).groupBy("h").agg(F.min("page").alias("page"))
    sample = [r.page for r in sorted(chosen.collect())]
    rows = pages.select(*carry, "html")
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_extract(len(carry), train(sample)), f"{types}, text string, n_chars long")
