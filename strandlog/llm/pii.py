"""Personal data by a character-level bidirectional LSTM with CRF transitions, in numpy.

The network is trained from labelled spans in texts made by a seeded generator (``TRAINING`` windows: a fixed bound).
A text is read in overlapping windows; where windows overlap, their emissions are averaged, weighted towards a
window's middle, and each stretch of windows is decoded as a whole by one Viterbi pass with the CRF's transitions.
What the network is for is written otherwise than the exact patterns ask: addresses with spaces or with words in
brackets for their signs, addresses of hosts with bracketed stops, phones without a plus, cards in groups by stops or of
other lengths, and cards beside other numbers. Its spans count, clipped to their kind's form, if the kind's check (digits,
Luhn sum, parts of an address) holds; the exact patterns give the base spans, and the network's are added where they touch none of these.

Every span holds a digit, an at sign or a bracketed "at". Windows that lie within WINDOW of one go through the network,
and so all that cover a place where a span can lie; other windows would be read for nothing (tested against a run over
all windows).

Nulls and edges: a null text is empty; rows that repeat are each reported; a null id is carried along; texts of any
length are read whole, in blocks of windows and in time linear in their length; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kinds in the order of results, and their exact patterns.
KINDS = ("email", "ip", "card", "phone")
EMAIL_LOCAL, EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9._%+-]"), re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match begins where digits begin and takes all of them: without the look-behind a long run of digits would be tried from each of them.
IP, CARD, PHONE = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"), re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]|[(\[{] ?at ?[)\]}]", re.I)

#: Windows of so many characters begin every STRIDE; the model's sizes; training windows, passes and seed.
WINDOW, STRIDE, HIDDEN, EMBED = 64, 32, 16, 10
TRAINING, EPOCHS, BATCH, SEED = 6000, 4, 64, 11
#: So many windows go through the network at once.
AT_ONCE = 1024
TAGS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]
CLASSES = "\0\n \"'()+,-./:;<=>@[]_%#|"  # one id each; then digits, lower, upper, other letters, the rest
N_CLASSES = len(CLASSES) + 5


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) << i % 2
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0") or "0"
    return len(part) <= 3 and int(part) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's number, start, end) by kind, then start: leftmost matches without overlaps, those that fail dropped."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:  # from each at sign to the left: a search from every place would take the square of a long run
        start = at
        while start > done and EMAIL_LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := EMAIL_DOMAIN.match(text, at + 1)):
            out.append((0, start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(map(_small, m.group().split(".")))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m.group())) <= 15]
    return out


AT, DOT = r"(?:\s?@\s?|\s?[\[({]\s?at\s?[\])}]\s?)", r"(?:\.|\s?[\[({]\s?(?:dot|\.)\s?[\])}]\s?)"
WRITTEN_EMAIL = re.compile(rf"[A-Za-z0-9._%+-]+{AT}[A-Za-z0-9-]+(?:{DOT}[A-Za-z0-9-]+)*{DOT}[A-Za-z][A-Za-z0-9-]+", re.I)
WRITTEN_IP = re.compile(r"[0-9]{1,3}(?:(?:\s?[\[({]\.[\])}]\s?|\s?\.\s?)[0-9]{1,3}){3}")
WRITTEN_CARD = re.compile(r"[0-9]+(?:[ .\-/]{1,2}[0-9]+)*")
WRITTEN_PHONE = re.compile(r"\+?(?:[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{2,4}[ .-][0-9]{3,6}(?:[ .-][0-9]{2,4})?")
#: By which digits numbers of other lengths than 16 begin if they are cards'.
CARD_HEADS = {13: ("4",), 14: ("30", "36", "38"), 15: ("34", "37")}


FORMS = (WRITTEN_EMAIL, WRITTEN_IP, WRITTEN_CARD, WRITTEN_PHONE)


def _clipped(kind: int, found: str) -> tuple[int, int] | None:
    """Where in a span that the network found its kind's form lies, if the kind's check holds for it."""
    m = FORMS[kind].search(found)
    if not m:
        return None
    digits = re.sub("[^0-9]", "", m.group())
    if kind == 1 and not all(map(_small, re.findall("[0-9]+", m.group()))):
        return None
    if kind == 2 and not (13 <= len(digits) <= 19 and digits.startswith(CARD_HEADS.get(len(digits), "")) and luhn(digits)):
        return None
    if kind == 3 and not 10 <= len(digits) <= 15:
        return None
    return m.span()


def codes(text: str) -> np.ndarray:
    """Class of each character."""
    table = np.full(128, N_CLASSES - 1, np.uint8)
    table[[ord(c) for c in CLASSES]] = range(len(CLASSES))
    table[48:58], table[97:123], table[65:91] = len(CLASSES), len(CLASSES) + 1, len(CLASSES) + 2
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(points < 128, table[np.minimum(points, 127)], len(CLASSES) + 3)


def labelled(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """n windows of made text with spans of the four kinds and things like them that are none: classes and tags."""
    r = np.random.default_rng(seed)
    digits = lambda k: "".join(map(str, r.integers(0, 10, k)))
    letters = lambda k, a="abcdefghijklmnopqrstuvwxyzéüñ": "".join(r.choice(list(a), k))
    pick = lambda *x: x[r.integers(len(x))]

    plain = "abcdefghijklmnopqrstuvwxyz"
    word = lambda a=2, b=9: letters(r.integers(a, b), plain)

    def number(length: int, head: str = "") -> str:  # what looks like a card's number; the sum is left to the check
        return head + digits(length - len(head))

    def card() -> str:
        if r.random() < 0.2:
            d = pick(number(13, "4"), number(15, "37"), number(15, "34"), number(14, "36"))
            s = pick("", " ", "-")
            return s.join((d[:4], d[4:10], d[10:])) if s and len(d) == 15 else d
        d, s = number(int(r.integers(16, 20)) if r.random() < 0.2 else 16), pick("", "", " ", "-", ".", ".", "  ", "/")
        return s.join(d[i : i + 4] for i in range(0, len(d), 4)) if s else d

    def email() -> str:
        local = word() + pick("", "", "." + digits(2), "." + word(), "_" + letters(3, plain), "+x", digits(2))
        at, dot = pick(("@", "."), ("@", "."), (" @ ", "."), ("@ ", "."), (" [at] ", " [dot] "), ("[at]", "[dot]"), (" (at) ", "."), ("(at)", "(dot)"), (" [at] ", "."), ("@", "[.]"), (" {at} ", " {dot} "))
        host = word(3, 8) + pick("", "", digits(1), "-" + letters(2, plain))
        tail = pick([word(3, 8), pick("com", "org", "net", "de")], [pick("com", "org", "net", "fr", "info")], [pick("co", "ac"), "uk"])
        return local + at + dot.join([host, *tail])

    def ip() -> str:
        return pick(".", ".", "[.]", "[.]", " . ", "(.)", " [.] ").join(str(x) for x in r.integers(0, 256, 4))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        plus = f"+{pick(digits(1), digits(2), digits(3))}"
        return pick(f"{plus} ({a}) {b}-{c}", f"{plus} {digits(3)} {digits(4)} {digits(3)}", f"({a}) {b}-{c}", f"({a}){b}-{c}", f"({a}) {b}.{c}", f"{a}-{b}-{c}", f"{a}-{b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"1-{a}-{b}-{c}", f"0{digits(2)} {digits(4)} {digits(4)}", f"00{digits(2)} {digits(3)} {digits(6)}", f"1 ({a}) {b}-{c}")

    make = (email, ip, card, phone)
    other = (
        lambda: "token = \"" + "".join(r.choice(list("0123456789abcdef"), 40)) + '"', lambda: "AKIA" + "".join(r.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 16)),
        lambda: f"{r.integers(1900, 2100)}-{r.integers(1, 13):02}-{r.integers(1, 29):02}", lambda: f"Version {digits(1)}.{digits(1)}", lambda: f"{digits(2)}:{digits(2)}:{digits(2)}",
        lambda: f"{digits(3)},{digits(3)}.{digits(2)}", lambda: digits(r.integers(1, 8)), lambda: f"@{letters(6, plain)}", lambda: f"{digits(1)}.{digits(1)}.{digits(2)}", lambda: "password=" + "".join(r.choice(list("0123456789abcdef"), 16)),
        lambda: f"{word()} at {word()}", lambda: f"({word()})", lambda: f"[{digits(1)}]", lambda: f"{digits(2)}.{digits(2)}.{r.integers(1900, 2100)}", lambda: f"{digits(3)} {word()} {digits(2)}", lambda: f"ISBN {digits(3)}-{digits(1)}-{digits(2)}",
    )
    xs, ys = np.zeros((n, WINDOW), np.uint8), np.zeros((n, WINDOW), np.uint8)
    for i in range(n):
        text, tags = "", []
        while len(text) < 2 * WINDOW:
            roll = r.random()
            if roll < 0.15:
                k = int(r.integers(4))
                piece = make[k]()
                t = [2 * k + 1] + [2 * k + 2] * (len(piece) - 1)
                if k == 2 and r.random() < 0.3:  # one number beside another
                    more = number(16)
                    piece, t = f"{piece} {more}", [*t, 0, 2 * k + 1, *[2 * k + 2] * (len(more) - 1)]
            else:
                piece = pick(*other)() if roll < 0.24 else letters(r.integers(1, 10))
                piece = piece.capitalize() if roll > 0.9 else piece
                t = [0] * len(piece)
            gap = pick(" ", " ", " ", " ", ", ", ". ", "\n", "### ", "&&& ")
            text, tags = text + piece + gap, tags + t + [0] * len(gap)
        a = int(r.integers(0, WINDOW))
        xs[i], ys[i] = codes(text)[a : a + WINDOW], tags[a : a + WINDOW]
        for j in range(WINDOW):  # a span cut off by the window's edge begins anew there
            if ys[i, j] and ys[i, j] % 2 == 0 and (j == 0 or ys[i, j - 1] not in (ys[i, j], ys[i, j] - 1)):
                ys[i, j] -= 1
    return xs, ys


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def _lstm(x, w, u, b):
    """x (B, T, E) to the hidden states (B, T, H) and what the way back needs."""
    n, steps, h = x.shape[0], x.shape[1], u.shape[0]
    z = x @ w + b
    hs, cs, gates = np.zeros((n, steps + 1, h), x.dtype), np.zeros((n, steps + 1, h), x.dtype), np.empty((n, steps, 4 * h), x.dtype)
    for t in range(steps):
        a = z[:, t] + hs[:, t] @ u
        g = gates[:, t]
        g[:, : 3 * h] = _sigmoid(a[:, : 3 * h])
        g[:, 3 * h :] = np.tanh(a[:, 3 * h :])
        cs[:, t + 1] = g[:, h : 2 * h] * cs[:, t] + g[:, :h] * g[:, 3 * h :]
        hs[:, t + 1] = g[:, 2 * h : 3 * h] * np.tanh(cs[:, t + 1])
    return hs[:, 1:], (x, hs, cs, gates)


def _lstm_back(d, kept, w, u):
    x, hs, cs, gates = kept
    h = u.shape[0]
    da = np.empty_like(gates)
    dh_next, dc_next = 0, 0
    for t in range(x.shape[1] - 1, -1, -1):
        g, tc = gates[:, t], np.tanh(cs[:, t + 1])
        i, f, o, q = (g[:, k * h : k * h + h] for k in range(4))
        dh = d[:, t] + dh_next
        dc = dh * o * (1 - tc * tc) + dc_next
        a = da[:, t]
        a[:, :h], a[:, h : 2 * h], a[:, 2 * h : 3 * h], a[:, 3 * h :] = dc * q * i * (1 - i), dc * cs[:, t] * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - q * q)
        dh_next, dc_next = a @ u.T, dc * f
    return da @ w.T, np.einsum("bte,btg->eg", x, da, optimize=True), np.einsum("bth,btg->hg", hs[:, :-1], da, optimize=True), da.sum((0, 1))


def _emissions(p, x):
    e = p["emb"][x]
    f, kf = _lstm(e, p["wf"], p["uf"], p["bf"])
    b, kb = _lstm(e[:, ::-1], p["wb"], p["ub"], p["bb"])
    both = np.concatenate([f, b[:, ::-1]], -1)
    return both @ p["out"] + p["bias"], (both, kf, kb)


def _lse(x, axis):
    m = x.max(axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis))


def allowed() -> np.ndarray:
    """Penalty of each transition: a span's inside follows its own kind only."""
    k = len(TAGS)
    a = np.zeros((k, k), np.float32)
    for j in range(2, k, 2):
        a[[i for i in range(k) if i not in (j, j - 1)], j] = -1e4
    return a


def _crf(em, tr, y):
    """Mean negative log likelihood and its gradients by emissions and transitions."""
    n, steps, k = em.shape
    al, be = np.empty_like(em), np.zeros_like(em)
    al[:, 0] = em[:, 0]
    for t in range(1, steps):
        al[:, t] = em[:, t] + _lse(al[:, t - 1, :, None] + tr, 1)
    for t in range(steps - 2, -1, -1):
        be[:, t] = _lse(tr + (em[:, t + 1] + be[:, t + 1])[:, None], 2)
    z = _lse(al[:, -1], 1)
    rows, cols = np.arange(n)[:, None], np.arange(steps)
    score = em[rows, cols, y].sum(1) + tr[y[:, :-1], y[:, 1:]].sum(1)
    de = np.exp(al + be - z[:, None, None])
    pair = np.exp(al[:, :-1, :, None] + tr + (em[:, 1:] + be[:, 1:])[:, :, None] - z[:, None, None, None]).sum((0, 1))
    de[rows, cols, y] -= 1
    np.add.at(pair, (y[:, :-1], y[:, 1:]), -1)
    return float((z - score).mean()), de / n, pair / n


@lru_cache(maxsize=2)
def train(n: int = TRAINING, epochs: int = EPOCHS, seed: int = SEED) -> dict[str, np.ndarray]:
    """The weights, by Adam on the CRF's likelihood. The same arguments give the same weights."""
    r, k = np.random.default_rng(seed), len(TAGS)
    w = lambda a, b: (r.normal(size=(a, b)) / np.sqrt(a)).astype(np.float32)
    p = {"emb": w(N_CLASSES, EMBED) * 3, "out": w(2 * HIDDEN, k), "bias": np.zeros(k, np.float32), "tr": np.zeros((k, k), np.float32)}
    for d in "fb":
        p |= {"w" + d: w(EMBED, 4 * HIDDEN), "u" + d: w(HIDDEN, 4 * HIDDEN), "b" + d: np.zeros(4 * HIDDEN, np.float32)}
        p["b" + d][HIDDEN : 2 * HIDDEN] = 1
    m, v, step, mask = {q: np.float32(0) for q in p}, {q: np.float32(0) for q in p}, 0, allowed()
    xs, ys = labelled(n, seed)
    for epoch in range(epochs):
        order = r.permutation(n)
        for a in range(0, n, BATCH):
            x, y = xs[order[a : a + BATCH]], ys[order[a : a + BATCH]].astype(int)
            em, (both, kf, kb) = _emissions(p, x)
            _, de, dtr = _crf(em, p["tr"] + mask, y)
            db = de @ p["out"].T
            g = {"out": np.einsum("bth,btk->hk", both, de, optimize=True), "bias": de.sum((0, 1)), "tr": dtr}
            ef, g["wf"], g["uf"], g["bf"] = _lstm_back(db[..., :HIDDEN], kf, p["wf"], p["uf"])
            eb, g["wb"], g["ub"], g["bb"] = _lstm_back(db[:, ::-1, HIDDEN:], kb, p["wb"], p["ub"])
            g["emb"] = np.zeros_like(p["emb"])
            np.add.at(g["emb"], x, ef + eb[:, ::-1])
            step += 1
            rate = np.float32(0.02 * (1 - 0.9 * (epoch * n + a) / (epochs * n)))
            for q in p:
                m[q], v[q] = 0.9 * m[q] + 0.1 * g[q], 0.99 * v[q] + 0.01 * g[q] ** 2
                p[q] = (p[q] - rate * m[q] / (1 - 0.9**step) / (np.sqrt(v[q] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return p | {"tr": p["tr"] + mask}


def viterbi(em: np.ndarray, tr: np.ndarray) -> np.ndarray:
    best, back = em[0], np.zeros(em.shape, np.int8)
    for t in range(1, len(em)):
        s = best[:, None] + tr
        back[t] = s.argmax(0)
        best = s.max(0) + em[t]
    out = np.empty(len(em), int)
    out[-1] = best.argmax()
    for t in range(len(em) - 1, 0, -1):
        out[t - 1] = back[t, out[t]]
    return out


def stretches(text: str) -> list[tuple[int, int]]:
    """(first, last window) of each run of windows within WINDOW of a trigger; window k begins at k * STRIDE."""
    runs: list[list[int]] = []
    last = (max(0, len(text) - 1)) // STRIDE
    for m in TRIGGER.finditer(text):
        a, b = max(0, (m.start() - 2 * WINDOW) // STRIDE + 1), min(last, (m.start() + WINDOW) // STRIDE)
        if runs and a <= runs[-1][1] + 1:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    return [(a, b) for a, b in runs]


def tagged(text: str, weights: dict[str, np.ndarray], everywhere: bool = False) -> list[tuple[int, int, int]]:
    """(kind's number, start, end) of the network's spans, before any check; ``everywhere``: of all windows."""
    out = []
    centre = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)[:, None]
    for a, b in [(0, max(0, len(text) - 1) // STRIDE)] if everywhere else stretches(text):
        start, size = a * STRIDE, (b - a) * STRIDE + WINDOW
        c = np.zeros(size, np.uint8)
        own = codes(text[start : start + size])
        c[: len(own)] = own
        em, weight = np.zeros((size, len(TAGS)), np.float32), np.zeros((size, 1), np.float32)
        for k in range(0, b - a + 1, AT_ONCE):
            at = np.arange(k, min(k + AT_ONCE, b - a + 1)) * STRIDE
            e, _ = _emissions(weights, c[at[:, None] + np.arange(WINDOW)])
            for i, s in enumerate(at):
                em[s : s + WINDOW] += e[i] * centre
                weight[s : s + WINDOW] += centre
        tags = viterbi(em[: len(own)] / weight[: len(own)], weights["tr"])
        begins = np.flatnonzero(tags % 2 == 1)
        for s in begins:
            e = s + 1
            while e < len(tags) and tags[e] == tags[s] + 1:
                e += 1
            out.append((int(tags[s]) // 2, start + int(s), start + e))
    return out


def spans(text: str, weights: dict[str, np.ndarray], everywhere: bool = False) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and those that the network adds; each by kind, then start."""
    base = base_spans(text)
    taken, ends, reach = sorted((s, e) for _, s, e in base), [], 0
    for _, e in taken:  # the furthest end up to each start
        reach = max(reach, e)
        ends.append(reach)
    added = []
    for k, s, e in tagged(text, weights, everywhere):
        if clip := _clipped(k, text[s:e]):
            s, e = s + clip[0], s + clip[1]
            before = bisect_left(taken, (e, -1))  # base spans that begin before this one's end
            if not before or ends[before - 1] <= s:
                added.append((k, s, e))
    return base, sorted(added)


def _scan(weights: dict[str, np.ndarray]):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
        for b in batches:
            found = []
            for x in b.column(1):
                text = x.as_py() or ""
                base, added = spans(text, weights) if TRIGGER.search(text) else ([], [])
                rows = sorted([(*s, True) for s in base] + [(*s, False) for s in added])
                found.append([{"kind": KINDS[k], "start": s, "end": e, "base": own} for k, s, e, own in rows])
            yield pa.RecordBatch.from_arrays([*b.columns[:1], pa.array(found, kind), *b.columns[2:]], ["doc_id", "found", *b.schema.names[2:]])

    return run


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, found: array<struct<kind, start, end, base>>) for every row, by kind, then start."""
    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_scan(train()), f"doc_id {kind}, found array<struct<kind:string,start:bigint,end:bigint,base:boolean>>")


def op9(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    listed = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("found", lambda s: s["base"])

    def count(kind: str):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return scan(docs).select("doc_id", *map(count, KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))


def _mask(weights: dict[str, np.ndarray], column: int, chars: int | None):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            out = []
            for x in b.column(column):
                text = x.as_py()
                if text and TRIGGER.search(text):
                    at, parts = 0, []
                    for s, e, k in sorted((s, e, k) for group in spans(text, weights) for k, s, e in group):
                        if e > at:
                            parts += [text[at : max(at, s)], f"<{KINDS[k].upper()}>" if s >= at else ""]
                            at = e
                    text = "".join(parts) + text[at:]
                out.append(text)
            cols = {column: pa.array(out, pa.string())}
            if chars is not None:
                cols[chars] = pa.array([None if t is None else len(t) for t in out], pa.int64()).cast(b.column(chars).type)
            yield pa.RecordBatch.from_arrays([cols.get(i, c) for i, c in enumerate(b.columns)], b.schema.names)

    return run


def mask(docs: DataFrame, text_col: str = "text", chars_col: str | None = None) -> DataFrame:
    """The rows of ``docs`` with each span replaced by its kind in angle brackets; overlapping spans become one place.

    ``chars_col``, if given, becomes the new text's length in code points.
    """
    at, names = docs.columns.index, docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])  # names may hold dots
    return plain.mapInArrow(_mask(train(), at(text_col), at(chars_col) if chars_col else None), plain.schema).toDF(*names)
