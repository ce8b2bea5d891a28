"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its text blocks (leaves). Each is described by hashed features of its tag
path (tags, class and id words of the ancestors), hashed words and a few figures. A bidirectional LSTM in
numpy reads the whole sequence and labels every block as article or not. It is trained on a bounded
sample of the pages: as they are, with labels from HTML's own sectioning elements, and rendered anew
into other layouts (menus, sidebars, notices, forms, adverts, comments) whose labels are known.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortlens.llm.common import fresh, map_arrow

#: Pages the model is trained on (smallest hashes of the ids).
TRAIN_PAGES = 200
PATH_DIM, WORD_DIM, FIGURES = 192, 64, 8
HIDDEN, EPOCHS, BATCH, RATE = 16, 8, 16, 0.01
#: Leaves of one batch of the labeller, padding included.
BATCH_LEAVES = 16_384

# HTML's own element names, by role.
RAW = {"script", "style", "template", "textarea", "title", "iframe"}
#: Blocks of their own that leave an open paragraph open.
WITHIN = {"noscript", "svg", "select", "option", "optgroup", "object", "button"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd",
    "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
    "math", "mrow", "mi", "mo", "mn", "ms", "mtext", "mspace", "msup", "msub", "msubsup", "mfrac", "msqrt", "mroot", "mover", "munder", "munderover",
    "mtable", "mtr", "mtd", "mstyle", "mpadded", "mphantom", "mmultiscripts", "mprescripts", "merror", "menclose", "semantics", "annotation"}
CLOSES_ITSELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

#: Elements nested deeper count as siblings, as in browsers.
DEPTH = 512

_START = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|/?[a-zA-Z])")
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
#: Rest of a tag; a quote counts where a value starts.
_ATTRIBUTES = re.compile(r"(?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|[\"'=])*+>")
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[a-z]+|[A-Z][a-z]*")


class Block:
    """Text of one leaf with its tag path."""

    __slots__ = ("path", "text", "linked")

    def __init__(self, path: tuple[str, ...], text: str, linked: int) -> None:
        self.path, self.text, self.linked = path, text, linked


class _Tags:
    """Markup of a page from left to right, in time linear in its length.

    A tag ends at the first ``>`` outside of quoted values. Where the quotes of a tag leave no ``>`` to
    the end of the page, quotes no longer count from there on, so one such scan is the only one.
    """

    def __init__(self, page: str) -> None:
        self.page, self.last, self.quotes = page, page.rfind(">"), True

    def next(self, pos: int) -> tuple[int, int, str, bool, str] | None:
        """(start, end, name in small letters, closing, attributes) of the next markup; the name is empty for comments and the like."""
        page = self.page
        while (m := _START.search(page, pos)) is not None:
            start, kind = m.start(), m.group()
            if kind == "<!--":
                if page.startswith((">", "->"), m.end()):  # an empty comment
                    return start, page.find(">", m.end()) + 1, "", False, ""
                end = page.find("-->", m.end())
                return start, len(page) if end < 0 else end + 3, "", False, ""
            if kind == "<![CDATA[":
                end = page.find("]]>", m.end())
                return start, len(page) if end < 0 else end + 3, "", False, ""
            if start > self.last:  # nothing ends any more: text
                return None
            if kind in ("<!", "<?"):
                return start, page.find(">", start) + 1, "", False, ""
            name = _NAME.match(page, start)
            rest = _ATTRIBUTES.match(page, name.end()) if self.quotes else None
            if rest is None:
                self.quotes = False
                end = page.find(">", name.end()) + 1
            else:
                end = rest.end()
            return start, end, name[2].lower(), bool(name[1]), page[name.end(): end - 1]
        return None

    def after_raw(self, name: str, pos: int) -> int:
        """End of the end tag that closes a raw text element, or of the page."""
        close = re.compile(rf"</{name}[\s/>]", re.I).search(self.page, pos)
        end = -1 if close is None else self.page.find(">", close.end() - 1)
        return len(self.page) if end < 0 else end + 1


def blocks_of(page: str) -> list[Block]:
    """All text blocks in page order, white space folded, without scripts, styles, comments and the title.

    Inline elements and line breaks do not end a block, all other tags do. Broken markup is taken as
    browsers do where it matters: a new block ends an open paragraph, unknown end tags are ignored, an
    unclosed comment or script runs to the end, a slash does not end a script outside of drawings. A
    ``<`` that no ``>`` follows is text. The tags of the head are ignored, since both may be omitted:
    besides raw text and void elements it holds nothing. Other elements, fallback content and formulas too, are
    blocks for the labeller.
    """
    found: list[Block] = []
    stack: list[str] = []
    names: list[str] = []
    open_: dict[str, int] = {}
    pieces: list[str] = []
    paths: dict[tuple[str, ...], tuple[str, ...]] = {}
    linked, pos, size = 0, 0, len(page)
    tags = _Tags(page)

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            if text:
                path = tuple(stack)
                found.append(Block(paths.setdefault(path, path), text, min(linked, len(text))))
            pieces.clear()
        linked = 0

    def pop_to(i: int) -> None:
        for n in names[i:]:
            open_[n] -= 1
        del stack[i:], names[i:]

    while pos < size:
        tag = tags.next(pos)
        start = size if tag is None else tag[0]
        if start > pos:
            pieces.append(page[pos:start])
            if open_.get("a"):
                linked += start - pos
        if tag is None:
            break
        _, pos, name, closing, attributes = tag
        if not name:
            continue
        if name in INLINE:
            if name == "br" or name == "wbr":
                pieces.append(" ")
            elif name == "a":
                open_["a"] = 0 if closing else 1
            continue
        flush()
        open_["a"] = 0
        if name == "head":
            continue
        if closing:
            if open_.get(name):
                i = len(names) - 1
                while names[i] != name:
                    i -= 1
                pop_to(i)
            continue
        if name in RAW:
            if not (attributes.endswith("/") and open_.get("svg")):
                pos = tags.after_raw(name, pos)
            continue
        if name in VOID:
            continue
        if name not in WITHIN and open_.get("p"):
            i = len(names) - 1
            while names[i] != "p":
                i -= 1
            pop_to(i)
        ends = CLOSES_ITSELF.get(name)
        if ends and names and names[-1] in ends:
            pop_to(len(names) - 1)
        if len(names) >= DEPTH:
            pop_to(DEPTH - 1)
        label = name
        if attributes and "=" in attributes:
            own = [x.lower() for g in _NAMES.findall(attributes) for v in g if v for x in _PART.findall(v)]
            if own:
                label = name + "." + ".".join(sorted(set(own)))
        stack.append(label)
        names.append(name)
        open_[name] = open_.get(name, 0) + 1
    flush()
    return found


def _slot(text: str, dim: int) -> int:
    return zlib.crc32(text.encode()) % dim


class _Slots(dict):
    """Slot of every word seen, by the hash of its bare small letters."""

    def __missing__(self, word: str) -> int:
        slot = self[word] = _slot(word.lower().strip(".,;:!?"), WORD_DIM)
        return slot


class Features:
    """Feature rows of block sequences; paths and words seen lately are remembered."""

    dim = PATH_DIM + WORD_DIM + FIGURES

    def __init__(self) -> None:
        self.paths: dict[tuple[str, ...], np.ndarray] = {}
        self.words = _Slots()

    def _path(self, path: tuple[str, ...]) -> np.ndarray:
        row = self.paths.get(path)
        if row is None:
            if len(self.paths) > 20_000:
                self.paths.clear()
            row = np.zeros(PATH_DIM, np.float32)
            # ancestors by distance: the four nearest each, then in stretches of doubled length up to the top
            top, size, bucket = len(path), 1, 0
            while top > 0:
                for label, n in Counter(path[max(0, top - size): top]).items():
                    tag, *own = label.split(".")
                    for key in [f"t{tag}", f"d{bucket}{tag}", *[f"c{c}" for c in own]]:
                        row[_slot(key, PATH_DIM)] += n
                top, bucket = top - size, bucket + 1
                size = 1 if bucket < 4 else 2 ** (bucket - 2)
            # a deep nest of wrappers does not drown the rest
            np.sqrt(row, out=row)
            norm = np.sqrt((row * row).sum())
            self.paths[path] = row = row / norm if norm else row
        return row

    def rows(self, blocks: list[Block]) -> np.ndarray:
        out = np.zeros((len(blocks), self.dim), np.float32)
        if len(self.words) > 300_000:
            self.words.clear()
        slot = self.words.__getitem__
        n = len(blocks)
        for i, b in enumerate(blocks):
            out[i, :PATH_DIM] = self._path(b.path)
            own = b.text.split()
            counts = np.bincount(np.fromiter(map(slot, own), np.int64, len(own)), minlength=WORD_DIM)
            out[i, PATH_DIM: PATH_DIM + WORD_DIM] = counts / np.sqrt((counts * counts).sum())
            size = len(b.text)
            out[i, -FIGURES:] = (np.log1p(size) / 8, np.log1p(len(own)) / 6, b.linked / size, float(b.text[-1] in ".!?"), min(len(b.path), 20) / 20,
                                 sum(map(b.text.count, ".,")) / size * 10, i / n, 1.0)
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class BlockLabeller:
    """One bidirectional LSTM layer and a logistic output, forward and backward pass in numpy."""

    def __init__(self, dim: int = Features.dim, hidden: int = HIDDEN, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.h = hidden
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p[f"x{d}"] = (rng.standard_normal((dim, 4 * hidden)) * 0.2).astype(np.float32)
            self.p[f"h{d}"] = (rng.standard_normal((hidden, 4 * hidden)) / np.sqrt(hidden)).astype(np.float32)
            bias = np.zeros(4 * hidden, np.float32)
            bias[hidden: 2 * hidden] = 1.0
            self.p[f"o{d}"] = bias
        self.p["w"] = (rng.standard_normal(2 * hidden) * 0.2).astype(np.float32)
        self.p["c"] = np.zeros(1, np.float32)

    def _scan(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """States over time for x of shape (time, batch, dim); padding leaves the state as it is."""
        t, b, _ = x.shape
        h, n = self.h, self.h
        z_all = x @ self.p[f"x{d}"] + self.p[f"o{d}"]
        hs, c, tape = np.zeros((t, b, h), np.float32), np.zeros((b, h), np.float32), []
        state = np.zeros((b, h), np.float32)
        for s in (range(t) if d == "f" else range(t - 1, -1, -1)):
            z = z_all[s] + state @ self.p[f"h{d}"]
            gates = _sigmoid(z[:, : 3 * n])
            i, f, o = gates[:, :n], gates[:, n: 2 * n], gates[:, 2 * n:]
            g = np.tanh(z[:, 3 * n:])
            new = f * c + i * g
            live = mask[s][:, None]
            tanh = np.tanh(new)
            if keep:
                tape.append((s, state, c, i, f, o, g, tanh, live))
            c = np.where(live, new, c)
            state = np.where(live, o * tanh, state)
            hs[s] = state
        return hs, tape

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        """Probability of being article text for every (time, batch)."""
        f, tape_f = self._scan(x, mask, "f", keep)
        b, tape_b = self._scan(x, mask, "b", keep)
        both = np.concatenate([f, b], 2)
        return _sigmoid(both @ self.p["w"] + self.p["c"]), (both, tape_f, tape_b)

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean log loss over the unpadded blocks and its gradients, by backpropagation through time."""
        prob, (both, tape_f, tape_b) = self.forward(x, mask, True)
        n, h = max(1, int(mask.sum())), self.h
        loss = -np.where(mask, np.where(y > 0, np.log(prob + 1e-9), np.log(1 - prob + 1e-9)), 0).sum() / n
        err = np.where(mask, prob - y, 0).astype(np.float32) / n
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        grad["w"] = np.einsum("tb,tbh->h", err, both)
        grad["c"] = np.array([err.sum()], np.float32)
        out = err[:, :, None] * self.p["w"]
        for d, tape, part in (("f", tape_f, out[:, :, :h]), ("b", tape_b, out[:, :, h:])):
            dh = np.zeros((x.shape[1], h), np.float32)
            dc = np.zeros_like(dh)
            dz_all = np.zeros((*x.shape[:2], 4 * h), np.float32)
            for s, before, c, i, f, o, g, tanh, live in reversed(tape):
                dh = dh + part[s]
                do = dh * tanh
                dnew = dc + dh * o * (1 - tanh * tanh)
                dz = np.concatenate([dnew * g * i * (1 - i), dnew * c * f * (1 - f), do * o * (1 - o), dnew * i * (1 - g * g)], 1) * live
                dz_all[s] = dz
                grad[f"h{d}"] += before.T @ dz
                dh = np.where(live, dz @ self.p[f"h{d}"].T, dh)
                dc = np.where(live, dnew * f, dc)
            grad[f"x{d}"] = np.einsum("tbi,tbj->ij", x, dz_all, optimize=True)
            grad[f"o{d}"] = dz_all.sum((0, 1))
        return float(loss), grad

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Probabilities for each page's blocks; pages of like length share a padded batch."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        while order:
            longest = len(pages[order[-1]])
            take = max(1, min(len(order), BATCH_LEAVES // longest))
            chosen, order = order[-take:], order[:-take]
            x, mask, _ = pad([pages[i] for i in chosen])
            prob, _ = self.forward(x, mask)
            for j, i in enumerate(chosen):
                out[i] = prob[: len(pages[i]), j]
        return out


def pad(pages: list[np.ndarray], labels: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    t = max(map(len, pages))
    x = np.zeros((t, len(pages), Features.dim), np.float32)
    mask, y = np.zeros((t, len(pages)), bool), np.zeros((t, len(pages)), np.float32)
    for j, p in enumerate(pages):
        x[: len(p), j] = p
        mask[: len(p), j] = True
        if labels is not None:
            y[: len(p), j] = labels[j]
    return x, mask, y


_APART = {"nav", "footer", "aside", "form", "header", "menu", "dialog"}
_APART_WORDS = {"ad", "ads", "advert", "banner", "sponsor", "promo", "cookie", "consent", "notice", "comment", "comments", "reply", "share", "social",
                "sidebar", "menu", "nav", "breadcrumb", "breadcrumbs", "footer", "related", "newsletter", "subscribe", "login", "search"}


def weak_label(block: Block, sectioned: bool) -> int:
    """Article or not by the innermost sectioning element that decides; 1 without one on unsectioned pages."""
    for label in reversed(block.path):
        tag, *own = label.split(".")
        if tag in _APART or _APART_WORDS & set(own):
            return 0
        if tag in ("article", "main"):
            return 1
    return 0 if sectioned else 1


def render(good: list[str], bad: list[str], rng: random.Random) -> tuple[str, list[int]]:
    """A page in a random layout around the given texts, and the labels of its blocks in order."""
    out, labels = [], []
    esc = lambda s: entities.escape(s, quote=False)
    piece = lambda: esc(rng.choice(bad)) if bad else "text"
    body = lambda: esc(rng.choice(good + bad)) if good or bad else "text"

    def put(s: str, *own: int) -> None:
        out.append(s)
        labels.extend(own)

    def links(tag: str, cls: str) -> None:
        n = rng.randint(3, 9)
        put(f"<{tag}{cls}><ul>" + "".join(f"<li><a href='/x'>{piece()[:24] or 'x'}</a></li>" for _ in range(n)) + f"</ul></{tag}>", *[0] * n)

    def extra() -> None:
        k = rng.randrange(7)
        if k == 0:
            put(f"<div class='{rng.choice(['ad', 'advert', 'ads banner', 'sponsored', 'promo'])}'>{body()}</div>", 0)
        elif k == 1:
            links(rng.choice(["nav", "div", "aside"]), rng.choice([" class='menu'", " id='nav'", " class='sidebar related'", ""]))
        elif k == 2:
            put(f"<div class='{rng.choice(['cookie-notice', 'consent', 'notice', 'alert'])}'><p>{piece()}</p><p>{piece()}</p></div>", 0, 0)
        elif k == 3:
            put(f"<form class='{rng.choice(['newsletter', 'login', 'search'])}'><p>{piece()[:60] or 'x'}</p><div>{piece()[:20] or 'x'}</div><input name='q'></form>", 0, 0)
        elif k == 4:
            put(f"<aside class='sidebar'><h3>{piece()[:30] or 'x'}</h3><p>{body()}</p></aside>", 0, 0)
        elif k == 5:
            n = rng.randint(1, 5)
            box = rng.choice(["<div class='comments'>", "<section id='comments'>", "<div class='comment-list'>"])
            put(box + "".join(f"<div class='comment'><div class='author'>{piece()[:12] or 'x'}</div><p>{body()}</p></div>" for _ in range(n))
                + ("</section>" if "section" in box else "</div>"), *[0] * (2 * n))
        else:
            put(f"<div class='share social'><a href='#'>{piece()[:10] or 'x'}</a> <a href='#'>{piece()[:10] or 'x'}</a></div>", 0)

    put("<!DOCTYPE html><html><head><title>t</title></head><body>")
    if rng.random() < 0.5:
        put(f"<header><h1>{piece()[:30] or 'x'}</h1></header>", 0)
    links(rng.choice(["nav", "div"]), rng.choice(["", " class='menu'", " id='top-nav'"]))
    for _ in range(rng.randint(0, 3)):
        extra()
    tag, cls = rng.choice([("article", ""), ("main", ""), ("div", " class='content'"), ("div", " id='main'"), ("section", " class='post'"), ("div", " class='article-body'"), ("div", " class='entry'"), ("article", " class='story'")])
    put(f"<{tag}{cls}>")
    for i, text in enumerate(good):
        if i == 0 and rng.random() < 0.7:
            put(f"<h1>{esc(text[:60]) or 'x'}</h1>", 1)
        way = rng.random()
        if way < 0.75:
            put(f"<p>{esc(text)}</p>", 1)
        elif way < 0.85:
            put(f"<p><b>{esc(text)}<br><p>", 1)
        elif way < 0.92:
            put(f"<ul><li>{esc(text)}</li></ul>", 1)
        else:
            put(f"<blockquote>{esc(text)}</blockquote>", 1)
        if rng.random() < 0.08:
            put(f"<div class='{rng.choice(['ad', 'advert', 'promo'])}'>{body()}</div>", 0)
    put(f"</{tag}>")
    for _ in range(rng.randint(0, 3)):
        extra()
    if rng.random() < 0.8:
        put(f"<footer>&copy; {piece()[:40] or 'x'}</footer>", 0)
    put("</body></html>")
    return "".join(out), labels


def training_set(pages: list[str], seed: int = 7) -> list[tuple[list[Block], np.ndarray]]:
    """The pages with weak labels and, for each, one page rendered from its own texts."""
    rng = random.Random(seed)
    out = []
    for page in pages:
        blocks = blocks_of(page)
        if not blocks:
            continue
        sectioned = any(x.split(".")[0] in ("article", "main") for b in blocks for x in b.path)
        labels = np.array([weak_label(b, sectioned) for b in blocks])
        out.append((blocks, labels))
        good = [b.text for b, k in zip(blocks, labels) if k][:60]
        bad = [b.text for b, k in zip(blocks, labels) if not k]
        made, own = render(good, bad, rng)
        parsed = blocks_of(made)
        if len(parsed) == len(own):
            out.append((parsed, np.array(own)))
    return out


def train(pages: list[str], epochs: int = EPOCHS, seed: int = 7) -> BlockLabeller:
    """Adam over batches of pages; the same pages give the same model."""
    features, model = Features(), BlockLabeller(seed=seed)
    data = [(features.rows(b), y) for b, y in training_set(pages, seed)]
    data.sort(key=lambda d: len(d[0]))
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    step = 0
    # long pages come in smaller batches, so a batch holds a bounded number of leaves unless one page has more
    batches, i = [], len(data)
    while i > 0:
        take = max(1, min(BATCH, i, BATCH_LEAVES // max(1, len(data[i - 1][0]))))
        batches.insert(0, data[i - take: i])
        i -= take
    for _ in range(epochs):
        for b in rng.permutation(len(batches)):
            x, mask, y = pad([d for d, _ in batches[b]], [y for _, y in batches[b]])
            _, grad = model.gradients(x, mask, y)
            step += 1
            for k, g in grad.items():
                g = np.clip(g, -1, 1)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                model.p[k] = (model.p[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", train_pages: int = TRAIN_PAGES,
                 names: tuple[str, str] = ("text", "n_chars"), model: BlockLabeller | None = None) -> DataFrame:
    """Append the main text and its length in characters to every page.

    Null and empty pages, and pages without article blocks, have an empty text. Repeated pages give
    repeated rows; an empty table stays empty. Columns of ``pages`` called like a result are replaced.
    ``train_pages`` bounds the sample the model is trained on; all pages are labelled with it.
    """
    pages = pages.drop(*names)
    if model is None:
        usable = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).where(F.length("html") > 0)
        # hashes alone are sorted; only the pages below the last of them are sent
        hashed = usable.withColumn("h", F.xxhash64("id", "html"))
        last = hashed.select("h").orderBy("h").limit(train_pages).agg(F.max("h")).first()[0]
        sample = [] if last is None else hashed.where(F.col("h") <= last).orderBy("h").limit(train_pages).collect()
        model = train([r["html"] for r in sample])
    shared = pages.sparkSession.sparkContext.broadcast(model)
    html = fresh(pages, "_html")
    at = len(pages.columns)
    workers: dict[int, Features] = {}

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        features = workers.setdefault(0, Features())
        texts: list[str] = []
        for i in range(0, batch.num_rows, 256):
            parsed = [blocks_of(p or "") for p in batch.column(at).slice(i, 256).to_pylist()]
            found = shared.value.label([features.rows(b) for b in parsed])
            texts.extend("\n".join(b.text for b, p in zip(blocks, prob) if p >= 0.5) for blocks, prob in zip(parsed, found))
        return {names[0]: texts, names[1]: [len(t) for t in texts]}

    return map_arrow(pages.withColumn(html, F.col(html_col)), run, {names[0]: "string", names[1]: "bigint"}, keep=pages.columns)
