"""Personal data by a character-level bidirectional LSTM with a CRF.

Whole texts are cut into overlapping windows; each is decoded by Viterbi over
the network's scores, and every character takes its label from the window in
whose middle it lies best. Spans that pass a check of their content are added
to those of the four base patterns: addresses that are spelt out, spaced or
not in ASCII, card numbers with dots, local phone numbers and the like, which
the network is shown in made-up windows.

One constraint of the CRF hangs on the text: a character can only be in a span
within REACH characters of a digit, an ``@`` or an ``(at)``, or in one word with
one. Windows without such a character decode to "outside" throughout and are
not computed; the result is that of decoding all (a test holds it to that).
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone")
#: Characters of a window, and of the step to the next one.
WINDOW, STEP = 64, 32
#: Cells of the LSTM in each direction.
CELLS = 24
#: Characters from a digit, an @ or an (at) that can be in a span.
REACH = 24
#: Documents the network is trained on at most, windows of each (spread over the text), and made-up windows.
SAMPLE_DOCS, SAMPLE_WINDOWS, MADE_UP = 400, 8, 4000
#: Documents, times SAMPLE_DOCS, among which those with a digit or @ are looked for.
SPREAD = 40
#: Windows that are decoded at a time.
BATCH = 1024

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_AT = re.compile(r"[(\[{] ?at ?[)\]}]", re.IGNORECASE)
#: Bytes of which a text with a span has one.
_TRIGGER_BYTES = np.zeros(256, bool)
_TRIGGER_BYTES[[*b"0123456789@([{"]] = True

Span = tuple[int, int, int]  # start, kind, end


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) << (i & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _ip_ok(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def _card_ok(text: str) -> bool:
    digits = text.replace(" ", "").replace("-", "")
    return 14 <= len(digits) <= 19 and _luhn(digits)


def _digits(text: str) -> int:
    return sum("0" <= c <= "9" for c in text)


def base_spans(text: str) -> list[Span]:
    """The matches of the four patterns, by start and kind; each pattern is matched in linear time."""
    out: list[Span] = []
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        at += 1
        if found:
            out.append((start, 0, found.end()))
            at = done = found.end()
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if _ip_ok(m.group())]
    out += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if _card_ok(m.group())]
    out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= _digits(m.group()) <= 15]
    return sorted(out)


def _char_table() -> np.ndarray:
    table = np.full(1 << 16, 1, np.int8)  # any other letter
    for point in range(1 << 16):
        char = chr(point)
        if "0" <= char <= "9":
            table[point] = 2
        elif "a" <= char <= "z":
            table[point] = 3
        elif "A" <= char <= "Z":
            table[point] = 4
        elif char.isspace():
            table[point] = 6
        elif not char.isalpha():
            table[point] = 5
    for code, char in enumerate(" @.-+()_%:", start=7):
        table[ord(char)] = code
    table[ord("\n")] = 17
    return table


_CLASSES = 18  # 0 lies past a text's ends
_TABLE: list[np.ndarray] = []


def _codes(text: str) -> np.ndarray:
    if not _TABLE:
        _TABLE.append(_char_table())
    return _TABLE[0][np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 0xFFFF)]


def _open_places(text: str, codes: np.ndarray) -> np.ndarray:
    """Which characters can be in a span."""
    marked = (codes == 2) | (codes == 8)  # digits and @
    for found in _AT.finditer(text):
        marked[found.start() : found.end()] = True
    if not marked.any():
        return marked
    at = np.flatnonzero(marked)
    edges = np.bincount(np.maximum(at - REACH, 0), minlength=len(text) + 1) - np.bincount(np.minimum(at + REACH + 1, len(text)), minlength=len(text) + 1)
    blank = (codes == 6) | (codes == 7) | (codes == 17)
    word = np.cumsum(blank)
    with_one = np.zeros(int(word[-1]) + 1, bool)
    with_one[word[at]] = True
    return (np.cumsum(edges[:-1]) > 0) | (with_one[word] & ~blank)


def _window_starts(open_places: np.ndarray) -> list[int]:
    """Starts of the windows with an open place; windows lie STEP apart from the text's start on."""
    blocks = -(-len(open_places) // STEP)
    padded = np.zeros(blocks * STEP, bool)
    padded[: len(open_places)] = open_places
    some = padded.reshape(blocks, STEP).any(axis=1)
    for back in range(1, WINDOW // STEP):
        some[:-back] |= some[back:]
    return (np.flatnonzero(some) * STEP).tolist()


_LABELS = 1 + 2 * len(KINDS)  # outside; begin and inside of each kind


def _allowed() -> np.ndarray:
    """0 where a label may follow another, else a large negative number."""
    allowed = np.full((_LABELS, _LABELS), -1e4)
    for before in range(_LABELS):
        for after in range(_LABELS):
            inside = after and after % 2 == 0
            if not inside or before in (after, after - 1):
                allowed[before, after] = 0
    return allowed


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class Tagger:
    """The network: gates (2 x classes x 4 cells), recurrence, output and transitions."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        scale = 1 / np.sqrt(CELLS)
        self.p = {
            "gate": rng.normal(0, 0.5, (2, _CLASSES, 4 * CELLS)),
            "turn": rng.uniform(-scale, scale, (2, CELLS, 4 * CELLS)),
            "out": rng.uniform(-scale, scale, (2, CELLS, _LABELS)),
            "bias": np.zeros(_LABELS),
            "move": np.zeros((_LABELS, _LABELS)),
        }
        self.p["gate"][:, :, CELLS : 2 * CELLS] += 1.0  # the forget gate starts open
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.allowed = _allowed().astype(np.float32)

    def _forward(self, codes: np.ndarray):
        p = self.p
        both = np.stack([codes, codes[:, ::-1]])  # direction, window, place
        n, length = codes.shape
        h = np.zeros((2, n, CELLS), np.float32)
        c = np.zeros_like(h)
        kept = []
        hidden = np.empty((2, length, n, CELLS), np.float32)
        for t in range(length):
            a = np.stack([p["gate"][d][both[d, :, t]] for d in (0, 1)]) + h @ p["turn"]
            gates = _sigmoid(a[..., : 3 * CELLS])
            new = np.tanh(a[..., 3 * CELLS :])
            i, f, o = gates[..., :CELLS], gates[..., CELLS : 2 * CELLS], gates[..., 2 * CELLS :]
            before = c
            c = f * before + i * new
            squashed = np.tanh(c)
            kept.append((i, f, o, new, before, squashed, h))
            h = o * squashed
            hidden[:, t] = h
        back = hidden[1, ::-1]
        scores = hidden[0] @ p["out"][0] + back @ p["out"][1] + p["bias"]
        return scores, (both, kept, hidden, back)  # scores: place, window, label

    def scores(self, codes: np.ndarray) -> np.ndarray:
        return self._forward(codes)[0]

    def step(self, codes: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the labels, and its gradients."""
        p = self.p
        scores, (both, kept, hidden, back) = self._forward(codes)
        length, n, _ = scores.shape
        move = p["move"] + self.allowed
        start = self.allowed[0]  # a window may begin inside a span, too
        start = np.zeros_like(start)
        alpha = np.empty_like(scores)
        alpha[0] = scores[0] + start
        for t in range(1, length):
            alpha[t] = scores[t] + _logsum(alpha[t - 1][:, :, None] + move, 1)
        total = _logsum(alpha[-1], 1)
        beta = np.zeros_like(scores)
        for t in range(length - 2, -1, -1):
            beta[t] = _logsum(move + (scores[t + 1] + beta[t + 1])[:, None, :], 2)
        marginal = np.exp(alpha + beta - total[None, :, None])
        d_scores = marginal
        d_move = np.zeros_like(p["move"])
        for t in range(1, length):
            pair = alpha[t - 1][:, :, None] + move + (scores[t] + beta[t])[:, None, :] - total[:, None, None]
            d_move += np.exp(pair).sum(axis=0)
        at = np.arange(n)
        gold = labels.T
        value = sum(scores[t, at, gold[t]] for t in range(length)) + sum(move[gold[t - 1], gold[t]] for t in range(1, length))
        for t in range(length):
            d_scores[t, at, gold[t]] -= 1
            if t:
                np.add.at(d_move, (gold[t - 1], gold[t]), -1)
        grad = {k: np.zeros_like(v) for k, v in p.items()}
        grad["move"] = d_move
        grad["bias"] = d_scores.sum(axis=(0, 1))
        grad["out"][0] = np.einsum("tnc,tnl->cl", hidden[0], d_scores)
        grad["out"][1] = np.einsum("tnc,tnl->cl", back, d_scores)
        d_hidden = np.stack([d_scores @ p["out"][0].T, (d_scores @ p["out"][1].T)[::-1]])
        dh = np.zeros((2, n, CELLS), np.float32)
        dc = np.zeros_like(dh)
        for t in range(length - 1, -1, -1):
            i, f, o, new, before, squashed, h = kept[t]
            dh = dh + d_hidden[:, t]
            dc = dc + dh * o * (1 - squashed**2)
            da = np.concatenate([dc * new * i * (1 - i), dc * before * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - new**2)], axis=2)
            grad["turn"] += h.transpose(0, 2, 1) @ da
            for d in (0, 1):
                np.add.at(grad["gate"][d], both[d, :, t], da[d])
            dh = da @ p["turn"].transpose(0, 2, 1)
            dc = dc * f
        return float((total - value).mean()), {k: v / n for k, v in grad.items()}

    def train(self, codes: np.ndarray, labels: np.ndarray, steps: int = 360, batch: int = 64, rate: float = 0.02, seed: int = 9) -> float:
        """Adam over random batches; returns the last loss."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        loss = 0.0
        for step in range(1, steps + 1):
            at = rng.integers(0, len(codes), batch)
            loss, grad = self.step(codes[at], labels[at])
            size = np.sqrt(sum(float((g**2).sum()) for g in grad.values()))
            for k, g in grad.items():
                g = g * min(1.0, 5.0 / (size + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g**2
                slope = rate * (1 - step / (steps + 1)) ** 0.5
                self.p[k] = (self.p[k] - slope * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return loss

    def decode(self, codes: np.ndarray, open_places: np.ndarray) -> np.ndarray:
        """The best label sequence of each window, outside where a place is not open."""
        scores = self.scores(codes)
        scores[:, :, 1:] += np.where(open_places.T, 0, -1e4).astype(np.float32)[:, :, None]
        length, n, _ = scores.shape
        move = self.p["move"] + self.allowed
        best = scores[0]
        came = np.zeros((length, n, _LABELS), np.int8)
        for t in range(1, length):
            through = best[:, :, None] + move
            came[t] = through.argmax(axis=1)
            best = scores[t] + through.max(axis=1)
        labels = np.empty((n, length), np.int8)
        labels[:, -1] = best.argmax(axis=1)
        for t in range(length - 1, 0, -1):
            labels[:, t - 1] = came[t, np.arange(n), labels[:, t]]
        return labels


def _labels(text: str, spans: list[Span]) -> np.ndarray:
    """Begin and inside labels of a text; of overlapping spans the earlier one counts."""
    out = np.zeros(len(text), np.int8)
    for start, kind, end in spans:
        if not out[start:end].any():
            out[start:end] = 2 * kind + 2
            out[start] = 2 * kind + 1
    return out


def _cut(values: np.ndarray, starts: list[int]) -> np.ndarray:
    padded = np.concatenate([values, np.zeros(WINDOW, values.dtype)])
    return np.stack([padded[s : s + WINDOW] for s in starts]) if starts else np.zeros((0, WINDOW), values.dtype)


_NAMES = ("jörg", "zoë", "renée", "søren", "łukasz", "иван", "maría", "müller", "àlex", "björk")


def _made_up(rng: np.random.Generator, kind: int, hard: bool) -> str:
    """A value of a kind; hard: in a form that the base patterns miss."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    pick = lambda *of: of[rng.integers(len(of))]
    word = lambda: "".join(letters[i] for i in rng.integers(0, 26, rng.integers(2, 9)))
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    if kind == 0:
        local, host, top = f"{word()}{pick('', '.' + word(), str(rng.integers(100)), '_' + word())}", word() + pick("", digits(1)), pick("com", "org", "net", "example.com", "de")
        if not hard:
            return f"{local}@{host}.{top}"
        if rng.random() < 0.3:
            return f"{pick(*_NAMES)}{pick('', '.' + word())}@{pick(host, pick(*_NAMES))}.{top}"
        at, dot = pick(" @ ", "(at)", " (at) ", "[at]", " [at] ", "@ ", " @"), pick(".", " . ", "(dot)", " (dot) ", "[dot]")
        return f"{local}{at}{host}{dot}{top.replace('.', dot)}"
    if kind == 1:
        parts = [str(x) for x in rng.integers(0, 256, 4)]
        return ".".join(parts) if not hard else pick("[.]", " . ", "(.)", " .").join(parts)
    if kind == 2:
        body = digits(15)
        body += next(str(d) for d in range(10) if _luhn(body + str(d)))
        sep = pick("", " ", "-") if not hard else pick(".", "/", " - ", "  ")
        return sep.join(body[j : j + 4] for j in range(0, 16, 4))
    if not hard:
        return pick(f"+{rng.integers(1, 99)} ({digits(3)}) {digits(3)}-{digits(4)}", f"+{digits(2)} {digits(3)} {digits(7)}")
    return pick(f"({digits(3)}) {digits(3)}-{digits(4)}", f"00{rng.integers(1, 99)} {digits(3)} {digits(7)}", f"0{digits(3)}/{digits(7)}", f"0{digits(2)} {digits(4)} {digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}")


def _invented(rng: np.random.Generator, n: int, hard: float = 0.5) -> list[tuple[str, list[Span]]]:
    """Windows around made-up values of every kind, a share of them hard, and around numbers and marks that are none."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    pick = lambda *of: of[rng.integers(len(of))]
    word = lambda: "".join(letters[i] for i in rng.integers(0, 26, rng.integers(1, 10)))
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    out = []
    for i in range(n):
        kind = i % (len(KINDS) + 2)
        before = " ".join(word() for _ in range(rng.integers(0, 4)))
        after = " ".join(pick(word(), word(), digits(rng.integers(1, 4))) for _ in range(rng.integers(0, 5)))
        own = kind < len(KINDS)
        if own:
            value = _made_up(rng, kind, rng.random() < hard)
        else:
            value = pick(
                digits(rng.integers(1, 9)), f"@{word()}", f"{digits(4)}-{digits(2)}-{digits(2)}", f"key={digits(3)}{word()}{digits(4)}", f"{digits(2)}:{digits(2)}", f"{digits(1)}.{digits(1)}.{digits(1)}",
                f"{digits(2)}.{digits(2)}.{digits(4)}", f"{digits(3)},{digits(3)}", f"{digits(20)}", f"{word()}_{digits(6)}{word()}{digits(4)}", f"{digits(2)} {digits(3)} {digits(2)}", f"({word()}) {digits(2)}", f"a@b", f"(at) {word()}",
            )
        start = len(before) + 1
        text = f"{before} {value}{pick('.', ',', '', '')} {after}"[:WINDOW]
        spans = base_spans(text)
        if own and start + len(value) <= WINDOW and not any(a < start + len(value) and start < b for a, _, b in spans):
            spans = sorted([*spans, (start, kind, start + len(value))])
        out.append((text, spans))
    return out


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 3) -> Tagger:
    """A tagger trained on labelled spans.

    The labels are the base spans of at most SAMPLE_DOCS documents with a
    digit or ``@`` (those with the smallest hashes of their ids, among about
    SPREAD x SAMPLE_DOCS documents), of each at most SAMPLE_WINDOWS windows all
    over the text, and the spans of MADE_UP made-up windows, half of which have
    forms that the base patterns miss.
    """
    base = docs.select(F.xxhash64(F.col(f"`{doc_id}`").cast("string")).alias("hash"), F.col(f"`{text}`").cast("string").alias("text"))
    # hashes are spread evenly: a bound leaves SPREAD times the sample, few of them for each task
    share = min(1.0, SPREAD * SAMPLE_DOCS / max(1, docs.count()))
    few = base.where(F.col("hash").cast("double") <= -(2.0**63) + share * 2.0**64) if share < 1 else base
    sample = few.where(F.col("text").rlike("[0-9@]")).mapInArrow(_sample_windows, "hash long, codes binary, labels binary")
    rows = sample.orderBy("hash", "codes").limit(SAMPLE_DOCS).collect()
    codes = [np.frombuffer(r.codes, np.int8).reshape(-1, WINDOW) for r in rows]
    labels = [np.frombuffer(r.labels, np.int8).reshape(-1, WINDOW) for r in rows]
    for made, spans in _invented(np.random.default_rng(seed), MADE_UP):
        codes.append(_cut(_codes(made), [0]))
        labels.append(_cut(_labels(made, spans), [0]))
    tagger = Tagger()
    tagger.train(np.concatenate(codes), np.concatenate(labels))
    return tagger


def _sample_windows(batches):
    for batch in batches:
        out: list[tuple] = []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            codes = _codes(text)
            starts = _window_starts(_open_places(text, codes))
            if starts:
                starts = [starts[i] for i in np.unique(np.linspace(0, len(starts) - 1, SAMPLE_WINDOWS).astype(int))]
                out.append((key, _cut(codes, starts).tobytes(), _cut(_labels(text, base_spans(text)), starts).tobytes()))
        out = sorted(out)[:SAMPLE_DOCS]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.int64(), pa.binary(), pa.binary()))], names=["hash", "codes", "labels"])


_SPELT_AT, _SPELT_DOT = re.compile(r"\s*(?:[(\[{] ?at ?[)\]}]|@)\s*", re.IGNORECASE), re.compile(r"\s*(?:[(\[{] ?(?:dot|\.) ?[)\]}]|\.)\s*", re.IGNORECASE)


def _passes(text: str, kind: int) -> bool:
    """The check of the content of a span that the network proposes, whatever separates its parts."""
    if kind == 0:
        local, at, domain = _SPELT_DOT.sub(".", _SPELT_AT.sub("@", text)).partition("@")
        return bool(at and re.fullmatch(r"[\w.%+-]+", local) and re.fullmatch(r"[\w-]+(\.[\w-]+)*\.[^\W\d_]{2,}", domain))
    if kind == 1:
        plain = _SPELT_DOT.sub(".", text)
        return bool(re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", plain)) and _ip_ok(plain)
    digits = re.sub("[^0-9]", "", text)
    if kind == 2:
        return bool(re.fullmatch(r"[0-9](?:[ ./-]{0,3}[0-9])+", text)) and 14 <= len(digits) <= 19 and _luhn(digits)
    return bool(re.fullmatch(r"[+(]?[0-9][0-9 ()./+-]*[0-9]", text)) and 9 <= len(digits) <= 15 and len(digits) < len(text)


def _proposed(texts: list[str], tagger: Tagger, all_windows: bool = False) -> list[list[Span]]:
    """The network's spans of whole texts: windows decoded in batches, labels taken from the window whose middle is nearest."""
    owner: list[int] = []
    places: list[int] = []
    parts: list[np.ndarray] = []
    opens: list[np.ndarray] = []
    out: list[list[Span]] = [[] for _ in texts]
    for i, text in enumerate(texts):
        own_codes = _codes(text)
        open_places = _open_places(text, own_codes)
        starts = list(range(0, len(text), STEP)) if all_windows else _window_starts(open_places)
        if starts:
            parts.append(_cut(own_codes, starts))
            opens.append(_cut(open_places, starts))
            owner += [i] * len(starts)
            places += starts
    if not parts:
        return out
    open_windows = np.concatenate(opens)
    codes = np.concatenate(parts)
    labels = np.concatenate([tagger.decode(codes[lo : lo + BATCH], open_windows[lo : lo + BATCH]) for lo in range(0, len(codes), BATCH)])
    merged: dict[int, dict[int, int]] = {}
    edge = (WINDOW - STEP) // 2
    for (i, start), row in zip(zip(owner, places, strict=True), labels, strict=True):
        at = np.flatnonzero(row)
        own = merged.setdefault(i, {})
        last = len(texts[i])
        for t in at.tolist():
            # the middle of a window is its own; its borders too at the text's ends
            if (edge <= t < WINDOW - edge) or (t < edge and start == 0) or (t >= WINDOW - edge and start + WINDOW >= last):
                own[start + t] = int(row[t])
    for i, own in merged.items():
        begun: int | None = None
        before = -2
        for place in [*sorted(own), len(texts[i]) + 2]:
            label = own.get(place, 0)
            goes_on = place == before + 1 and label and label % 2 == 0 and begun is not None and (own[begun] + 1) // 2 == label // 2
            if not goes_on:
                if begun is not None:
                    out[i].append((begun, (own[begun] + 1) // 2 - 1, before + 1))
                begun = place if label else None
            before = place
    return out


def find_spans(texts: list[str], tagger: Tagger) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text; spans are (start, kind, end) in code points."""
    proposed = _proposed(texts, tagger)
    out = []
    for text, extra in zip(texts, proposed, strict=True):
        base = base_spans(text)
        taken = np.zeros(len(text) + 1, bool)
        for start, _, end in base:
            taken[start:end] = True
        added = []
        for start, kind, end in extra:
            if not taken[start:end].any() and _passes(text[start:end], kind):
                added.append((start, kind, end))
        out.append((base, sorted(base + added)))
    return out


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first kind in brackets."""
    out, done = [], 0
    for start, kind, end in spans:
        if start >= done:
            out += [text[done:start], f"[{KINDS[kind].upper()}]"]
        done = max(done, end)
    return "".join(out) + text[done:]


RESULT = T.StructType(
    [T.StructField(f"n_{k}", T.LongType()) for k in KINDS]
    + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("redacted", T.StringType())]
)


def detect(docs: DataFrame, tagger: Tagger, text: str = "text", redacted: bool = True) -> DataFrame:
    """Append RESULT's columns: counts and digest of the base spans, all spans, and the text without them.

    Null and empty texts have no spans (a null text stays null when redacted).
    Columns of ``docs`` that share a result's name are replaced by it.
    """
    fields = [f for f in RESULT.fields if redacted or f.name != "redacted"]
    kept = [c for c in docs.columns if c not in {f.name for f in fields}]
    schema = T.StructType([docs.schema[c] for c in kept] + fields)
    base = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(tagger)
    empty = ([], [])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        from stridewise.llm import textbytes as tb

        target = to_arrow_schema(schema)
        for batch in batches:
            column = batch.column(len(kept))
            found: dict[int, tuple[list[Span], list[Span]]] = {}
            words: dict[int, str] = {}
            for first, raw, offsets in tb.text_slices(column):
                # rows without a digit, an @ or a bracket have no span of any kind
                sums = np.concatenate([[0], np.cumsum(_TRIGGER_BYTES[raw])])
                rows = (first + np.flatnonzero(sums[offsets[1:]] > sums[offsets[:-1]])).tolist()
                texts = [column[i].as_py() for i in rows]
                for i, text_, spans in zip(rows, texts, find_spans(texts, shared.value), strict=True):
                    found[i] = spans
                    words[i] = text_
            rows_ = [found.get(i, empty) for i in range(batch.num_rows)]
            arrays = [batch.column(i).cast(target.field(i).type) for i in range(len(kept))]
            for kind in range(len(KINDS)):
                arrays.append(pa.array([sum(k == kind for _, k, _ in b) for b, _ in rows_], pa.int64()))
            arrays.append(pa.array([hashlib.sha256(written(b).encode()).hexdigest() for b, _ in rows_], pa.string()))
            arrays.append(pa.array([written(a) for _, a in rows_], pa.string()))
            if redacted:
                plain = column.to_pylist()
                arrays.append(pa.array([redact(plain[i], rows_[i][1]) if i in found else plain[i] for i in range(batch.num_rows)], pa.string()))
            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, target, strict=True)], schema=target)

    return base.mapInArrow(run, schema)
