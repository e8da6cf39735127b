"""Markup, references, slugs, links and JSON as column expressions; names are bound when a document is read."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The chat service's markup. The order of rewrites is part of the meaning.
USER, CHANNEL = r"<@(U[A-Z0-9]+)(?:\|[^>]+)?>", r"<#(C[A-Z0-9]+)(?:\|[^>]+)?>"
REWRITES = (
    (USER, "<@$1>"),
    (CHANNEL, "<#$1>"),
    (r"<(https?://[^|>]+)\|([^>]+)>", "[$2]($1)"),
    (r"<(https?://[^|>]+)>", "$1"),
    (r"<!(here|channel|everyone)>", "@$1"),
    (r"<!subteam\^[A-Z0-9]+\|(@[^>]+)>", "$1"),
    (r"<!subteam\^([A-Z0-9]+)>", "@$1"),
    (r"(?<!\*)\*([^*\n]+)\*(?!\*)", "**$1**"),
    (r"(?<!_)_([^_\n]+)_(?!_)", "*$1*"),
    (r"(?<!~)~([^~\n]+)~(?!~)", "~~$1~~"),
)
SLUG_LENGTH = 60


def structural(text: Column) -> Column:
    """Markup to markdown; references lose their labels and stay placeholders for a later pass."""
    out = F.coalesce(text, F.lit(""))
    for pattern, to in REWRITES:
        out = F.regexp_replace(out, pattern, to)
    return out


def mentions(text: Column, pattern: str) -> Column:
    """The distinct ids that a text refers to, in order of first mention."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(1)))


@F.pandas_udf(StringType())
def _ascii(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    import unicodedata

    for s in texts:
        yield s.map(lambda t: unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode("ascii"), na_action="ignore")


def slugify(text: Column, plain: bool = False) -> Column:
    """A name for a file: ASCII letters and digits with hyphens, 60 characters at most, cut at a hyphen past 20.

    ``plain``: the text is known to be ASCII, and needs no decomposition of accents, which Spark has no function for.
    """
    own = F.coalesce(text, F.lit(""))
    # only texts with other letters are sent to Python
    ascii_ = own if plain else F.coalesce(_ascii(F.when(~own.rlike(r"\A\p{ASCII}*\z"), own)), own)
    base = F.trim(F.regexp_replace(F.lower(ascii_), "[^a-z0-9]+", "-"), F.lit("-"))
    cut = F.left(base, F.lit(SLUG_LENGTH))
    last = F.length(cut) - F.instr(F.reverse(cut), "-")
    return F.when(F.length(base) <= SLUG_LENGTH, base).when((F.instr(cut, "-") > 0) & (last > 20), F.left(cut, last)).otherwise(cut)


def permalink(url: Column) -> Column:
    """struct<channel_id, message_ts, thread_ts, error> of a link to a message or channel; error says why there is none."""
    path = F.trim(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), F.lit("/"))
    parts = F.split(path, "/")
    raw = F.substring(F.get(parts, F.lit(2)), 2, 1_000)
    n = F.size(parts)
    error = (
        F.when((n < 2) | (F.get(parts, F.lit(0)) != "archives"), "no archive").when(n == 2, None)
        .when((n != 3) | ~F.startswith(F.get(parts, F.lit(2)), F.lit("p")), "no message").when(~raw.rlike(r"\A[0-9]{11,}\z"), "bad time")
    )
    thread = F.try_parse_url(url, F.lit("QUERY"), F.lit("thread_ts"))
    ok = error.isNull()
    ts = F.when(ok & (n == 3), F.concat(F.left(raw, F.lit(10)), F.lit("."), F.substring(raw, 11, 1_000)))
    return F.struct(F.when(ok, F.get(parts, F.lit(1))).alias("channel_id"), ts.alias("message_ts"), F.when(ok, thread).alias("thread_ts"), error.alias("error"))


def json_has_key(json: Column, key: str) -> Column:
    """Whether an object has a key, even with the value null."""
    return F.coalesce(F.array_contains(F.json_object_keys(json), key), F.lit(False))


def canonical_json(json: Column) -> Column:
    """JSON with sorted keys and no spaces, so that equal values are equal texts; malformed JSON gives null.

    Numbers are written as their values, 1.50 as 1.5, so that what differs in notation alone is equal too.
    """
    return F.to_json(F.try_parse_json(json))


#: What stands before and after the text of an element of a shared document.
AROUND = {"b": ("**", "**"), "strong": ("**", "**"), "i": ("*", "*"), "em": ("*", "*"), "li": ("\n- ", ""), "p": ("\n", "\n"), **{f"h{n}": ("\n" + "#" * n + " ", "\n") for n in range(1, 7)}}
HEADINGS = tuple(f"h{n}" for n in range(1, 7))


class _Walk(HTMLParser):
    """Collects markdown as tags open and close. An element's text is put together when it closes; one that is never closed
    leaves its text as it is."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.open: list[tuple[str, dict[str, str | None], int]] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = dict(attrs)
        if tag == "br":
            self.parts.append("\n")
        elif tag == "hr":
            self.parts.append("\n---\n")
        elif tag == "input":
            self.parts.append(("[x] " if "checked" in a else "[ ] ") if a.get("type") == "checkbox" else "")
        elif tag == "p":
            self.parts.append("\n")  # paragraphs need no end tag
        else:
            if tag == "img":
                self.parts.append(f":{a['alt']}:" if a.get("alt") is not None else "")
            self.open.append((tag, a, len(self.parts)))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if self.open and self.open[-1][0] == tag == "img":
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        if tag == "p":
            self.parts.append("\n")
            return
        place = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if place is None:
            return
        _, a, start = self.open[place]
        del self.open[place:]
        inner = "".join(self.parts[start:])
        del self.parts[start:]
        before, after = AROUND.get(tag, ("", ""))
        if tag == "a" and a.get("href") is not None:
            before, after = "[", f"]({a['href']})"
        if tag in HEADINGS:
            inner = inner.strip()
        if tag not in ("img", "script", "style"):
            self.parts.append(before + inner + after)

    def handle_data(self, data: str) -> None:
        self.parts.append(data)


def _markdown(page: str) -> str | None:
    start = page.find("<h1")
    if start < 0:
        return None
    end = page.find("</body>", start)
    walk = _Walk()
    walk.feed(page[start:] if end < 0 else page[start:end])
    walk.close()
    out = re.sub(r"(:[a-z0-9_-]+)\1:", r"\1:", "".join(walk.parts))  # an image's name between colons, said twice
    return re.sub(r"\n\n\n+", "\n\n", re.sub("  +", " ", out)).strip()


@F.udf(StringType(), useArrow=False)
def canvas_markdown(page: str | None) -> str | None:
    """Markdown of a shared document's page, from its first heading to the end of its body; null without a heading.

    Pages go to Python a hundred at a time, and not as many as an Arrow batch holds: they can be large.
    """
    return None if page is None else _markdown(page)
