"""A page's leaf blocks: the runs of text between block-level tags, with the path of tags they stand in.

A page is read in time that grows with its length, however deep its elements nest and whatever they leave open. What the
classifier reads of a block's place is defined by ``DEPTH`` and ``NAMES``; the block's text is always whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa

from millrace.llm.common import LETTERS, words_of

#: HTML's elements without content, elements whose content isn't shown, and elements that begin and end a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style template head title noscript svg math iframe object canvas select datalist textarea".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag ends an open element of these, as HTML's optional end tags have it.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: What a head may hold; anything else ends it.
_HEAD = frozenset("html head base link meta title style script noscript template basefont bgsound noframes".split())
#: Hidden elements that only their end tag ends; script and style are read as text by the parser, and a head ends by itself.
_ENDED = HIDDEN - {"head", "script", "style"}
_ENDED_TAG = re.compile(rf"<(/?)({'|'.join(sorted(_ENDED))})(?![^\s/>])", re.I)
_SCOPES = frozenset("ul ol dl table tr article section main aside nav div body".split())

#: Of a block's place the innermost ``DEPTH`` different tags with their names are features, each once, however often it is
#: nested in itself; they are looked for among the innermost ``SCAN`` open elements. Of a tag's names the first few count.
DEPTH, SCAN, NAMES = 12, 64, 8
PATH_DIM, WORD_DIM, FACTS = 48, 24, 8
INPUT = PATH_DIM + WORD_DIM + FACTS


class Unended(HTMLParser):
    """Collects the hidden elements that have no end tag, by their number among the start tags of hidden elements."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.starts: dict[str, list[int]] = {tag: [] for tag in _ENDED}
        self.n = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _ENDED:
            self.starts[tag].append(self.n)
            self.n += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        pass

    def handle_endtag(self, tag: str) -> None:
        if self.starts.get(tag):
            self.starts[tag].pop()


def unended(html: str) -> frozenset[int]:
    """Numbers of the hidden elements without an end tag; pages in which as many tags start as end are not parsed for it."""
    tally = Counter((tag.lower(), bool(end)) for end, tag in _ENDED_TAG.findall(html))
    if all(tally[tag, False] == tally[tag, True] for tag, _ in list(tally)):
        return frozenset()
    page = Unended()
    page.feed(html)
    page.close()
    return frozenset(n for own in page.starts.values() for n in own)


class Blocks(HTMLParser):
    """Collects ``found``: (path, text, characters in links, characters emphasised) of each block, in page order.

    ``unended``: numbers of hidden elements without an end tag; these end with their parent or at the next block.
    """

    def __init__(self, unended: frozenset[int] = frozenset()) -> None:
        super().__init__(convert_charrefs=True)
        self.unended, self.n = unended, 0
        self.loose: list[tuple[int, bool]] = []  # where the open hidden elements are, and whether they have no end tag
        self.at: dict[str, list[int]] = {}  # by tag, where its open elements are
        self.found: list[tuple[tuple[str, ...], str, int]] = []
        self.open: list[tuple[str, str]] = []
        self.parts: list[str] = []
        self.linked = self.links = self.hidden = 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            labels = list(dict.fromkeys(label for _, label in reversed(self.open[-SCAN:])))[:DEPTH]
            self.found.append((tuple(reversed(labels)), text, self.linked))
        self.parts, self.linked = [], 0

    def _pop(self, at: int) -> None:
        if any(t in BLOCKS for t, _ in self.open[at:]):
            self.flush()
        for tag, _ in self.open[at:]:
            self.at[tag].pop()
            self.links -= tag == "a"
            if tag in HIDDEN:
                self.hidden -= 1
                self.loose.pop()
        del self.open[at:]

    def _end_head(self, tag: str) -> None:
        """A head ends at a body, and at anything in it that a head can't hold."""
        if tag == "body":
            if self.at.get("head"):
                self._pop(self.at["head"][0])
        elif tag not in _HEAD and self.open and self.open[-1][0] == "head":
            self._pop(len(self.open) - 1)

    def _end_loose(self) -> None:
        while self.loose and self.loose[-1][1]:
            self._pop(self.loose[-1][0])

    def _last(self, tags: Iterable[str]) -> int:
        """Where the innermost open element of these is, -1 if there is none."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def _close(self, tags: tuple[str, ...]) -> None:
        at = self._last(tags)
        if at >= 0 and at >= self._last(_SCOPES):
            self._pop(at)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.hidden:
            if tag in BLOCKS and tag != "option":
                self._end_loose()
            self._end_head(tag)
        if tag in VOID:
            self.parts.append(" ")
            if tag == "hr":
                self.flush()
            return
        if tag in BLOCKS:
            self._close((*_CLOSES.get(tag, ()), "p"))
            self.flush()
        held = dict(attrs)
        label = " ".join([tag, *f"{held.get('class') or ''} {held.get('id') or ''} {held.get('role') or ''}".lower().replace("-", " ").replace("_", " ").split()[:NAMES]])
        self.at.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, label))
        self.links += tag == "a"
        if tag in HIDDEN:
            self.hidden += 1
            self.loose.append((len(self.open) - 1, tag in _ENDED and self.n in self.unended))
            self.n += tag in _ENDED

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self.at.get(tag):
            self._pop(self.at[tag][-1])

    def handle_data(self, data: str) -> None:
        if self.hidden and self.open[-1][0] == "head" and data.strip():
            self._end_head("")
        if not self.hidden:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)


def blocks_of(html: str) -> list[tuple[tuple[str, ...], str, int]]:
    page = Blocks(unended(html))
    page.feed(html)
    page.close()
    page.flush()
    return page.found


_paths: dict[tuple[str, ...], np.ndarray] = {}


def path_vector(path: tuple[str, ...]) -> np.ndarray:
    """Signed hashes of the words of each tag of a path, those further up weaker; the innermost tag also counts apart."""
    if (v := _paths.get(path)) is None:
        v = np.zeros(PATH_DIM, np.float32)
        for depth, label in enumerate(reversed(path)):
            for word in label.split():
                h = zlib.crc32(word.encode("utf-8", "replace"))
                v[h % PATH_DIM] += (1 if h & 0x10000 else -1) * max(0.5, 1 - 0.06 * depth)
                h = zlib.crc32(b"|" + word.encode("utf-8", "replace"))
                v[(h >> 3) % PATH_DIM] += (1 if h & 0x20000 else -1) * max(0.5, 1 - 0.06 * depth)
        if path:
            h = zlib.crc32(b"=" + path[-1].split()[0].encode())
            v[h % PATH_DIM] += 1 if h & 0x10000 else -1
        if len(_paths) > 20_000:
            _paths.clear()
        _paths[path] = v
    return v


def features(found: list[tuple[tuple[str, ...], str, int]]) -> np.ndarray:
    """A row of ``INPUT`` numbers for each block of a page."""
    n = len(found)
    out = np.zeros((n, INPUT), np.float32)
    words = words_of(pa.array([text for _, text, _ in found], pa.string()), LETTERS)
    at, count = words.text_of(), words.count
    slot = (words.hash % np.uint64(WORD_DIM)).astype(np.int64)
    sign = np.where((words.hash >> np.uint64(40)) & np.uint64(1), 1.0, -1.0)
    out[:, PATH_DIM : PATH_DIM + WORD_DIM] = np.tanh(np.bincount(at * WORD_DIM + slot, sign, n * WORD_DIM) / np.sqrt(np.maximum(1, np.repeat(count, WORD_DIM)))).reshape(n, WORD_DIM)
    for i, (path, text, linked) in enumerate(found):
        out[i, :PATH_DIM] = path_vector(path)
        size = len(text)
        out[i, PATH_DIM + WORD_DIM :] = (
            np.log1p(count[i]) / 4, min(1.0, linked / size), (text.count(".") + text.count(",")) / (1 + count[i]), text[-1] in ".!?\"”»…",
            i / n, 1.0 if i == 0 else 0.0, len(path) / DEPTH, sum(map(text.count, "0123456789")) / size,
        )
    return out
