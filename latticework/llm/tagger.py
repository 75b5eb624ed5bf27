"""A character-level bidirectional LSTM with CRF transitions, in numpy.

Trained from labelled spans: texts of invented words in which personal data, secrets
and look-alikes (dates, versions, digests, identifiers) stand at known places.  The
training set, its order and the first weights come from a seed, so every process
trains the same network.
"""

from __future__ import annotations

import random
from functools import cache

import numpy as np

KINDS = ("email", "ip", "card", "phone", "secret")  # the base rules know the first four
TAGS = 1 + 2 * len(KINDS)  # outside; begin and inside of each kind
WINDOW, STRIDE, HIDDEN = 128, 64, 16
SAMPLES, EPOCHS, BATCH, RATE = 6000, 8, 96, 0.02
_FORBIDDEN = -1e4

# a class for each ASCII letter and mark, one for all digits and one for all beyond ASCII; 0 pads
CLASSES = 130
_ASCII = np.arange(1, 129, dtype=np.uint8)
_ASCII[48:58] = 49
_GROUPS = (range(97, 123), range(65, 91))  # letters begin with equal weights, by case


def classes(points: np.ndarray) -> np.ndarray:
    """The class of each code point."""
    return np.where(points < 128, _ASCII[np.minimum(points, 127)], 129).astype(np.uint8)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


# -- labelled texts -------------------------------------------------------------

_SYLLABLES = "an er th on in re ed ha ti st ou le que ción sch ver lich äu é or en ble ing ation".split()


def _word(rng: random.Random) -> str:
    w = "".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 4)))
    return rng.choice((w, w, w, w, w.capitalize(), w.upper(), w + ",", w + "."))


def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _name(rng: random.Random) -> str:
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))


def _card(rng: random.Random) -> str:
    size = rng.choice((15, 16, 16, 16))
    body = rng.choice("3456") + _digits(rng, size - 2)
    number = next(body + d for d in "0123456789" if luhn(body + d))
    mark = rng.choice(" -./")
    cuts = (4, 8, 12) if size == 16 else (4, 10)
    return number if rng.random() < 0.3 else mark.join(number[i:j] for i, j in zip((0, *cuts), (*cuts, size), strict=True))


def _email(rng: random.Random) -> str:
    user = rng.choice((_name(rng), f"{_name(rng)}.{_name(rng)}", f"{_name(rng)}.{_digits(rng, 2)}", f"{_name(rng)}_{_digits(rng, 1)}", f"{_name(rng)}+{_name(rng)}", f"{_name(rng)}{_digits(rng, 2)}".capitalize()))
    host = rng.choice((_name(rng), f"mail{_digits(rng, 1)}.{_name(rng)}", f"{_name(rng)}-{_name(rng)}"))
    return user + rng.choice(("@", "@", "@", " @ ", "[@]", " [@] ")) + host + rng.choice((".com", ".org", ".co.uk", ".de", ".net", " . com"))


def _ip(rng: random.Random) -> str:
    return rng.choice((".", ".", ".", " . ")).join(str(rng.randint(0, 255)) for _ in range(4))


def _phone(rng: random.Random) -> str:
    a, b, c, n = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4), rng.randint(1, 99)
    return rng.choice((f"+{n} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"({a}) {b} {c}", f"{a}-{b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"1-{a}-{b}-{c}", f"+{n} {a} {b} {c}", f"+{n}-{a}-{b}-{c}", f"0{a} / {_digits(rng, 6)}", f"0{_digits(rng, 2)} {_digits(rng, 3)} {_digits(rng, 4)}"))


def _secret(rng: random.Random) -> tuple[str, str, str]:
    """What stands before a secret, the secret, and what follows it."""
    signs = rng.choice(("0123456789abcdef", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"))
    said = rng.choice(("", "", "", "sk-", "ghp_", "AKIA")) + "".join(rng.choice(signs) for _ in range(rng.choice((20, 24, 32, 40, 40))))
    name = rng.choice(("token", "token", "api_key", "apikey", "secret", "secret_key", "password", "passwd", "access_token", "auth", "key"))
    name, quote = rng.choice((name, name, name.upper(), name.capitalize())), rng.choice(('"', '"', "'", ""))
    return f"{name}{rng.choice((' = ', '=', ': ', ' '))}{quote}", said, quote


def _look_alike(rng: random.Random) -> str:
    hexed = "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice((18, 32, 40))))
    return rng.choice(
        (
            f"Version {rng.randint(1, 9)}.{rng.randint(0, 9)}.", f"version {rng.randint(1, 9)}.", f"{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 20)}", f"20{_digits(rng, 2)}-{_digits(rng, 2)}-{_digits(rng, 2)}",
            f"{rng.randint(1, 31)}.{rng.randint(1, 12)}.20{_digits(rng, 2)}", f"{rng.randint(0, 23)}:{_digits(rng, 2)}:{_digits(rng, 2)}", f"commit {hexed}", f"sha1 {hexed}", f"digest: {hexed}", f"token {rng.randint(1, 99)}", f"{hexed[:8]}-{hexed[4:8]}-{hexed[8:12]}-{hexed[2:6]}-{hexed[4:16]}", f"${rng.randint(1, 9)},{_digits(rng, 3)}.{_digits(rng, 2)}",
            f"#{_digits(rng, rng.randint(4, 12))}", f"{_digits(rng, rng.randint(4, 20))}", f"@{_name(rng)}", f"{rng.randint(1, 9)} @ {rng.randint(1, 9)}", f"978-{_digits(rng, 1)}-{_digits(rng, 2)}-{_digits(rng, 6)}-{_digits(rng, 1)}", f"{_digits(rng, 4)}-{_digits(rng, 4)}", f"({rng.randint(1, 99)})", f"1{_digits(rng, 9)}",
        )
    )


def _cue(rng: random.Random, kind: str) -> str:
    """A word that often stands before data of a kind."""
    return rng.choice({"email": ("mail ", "Email: ", "contact "), "ip": ("host ", "from ", "IP: "), "card": ("card ", "Visa: ", "no. "), "phone": ("tel ", "Tel.: ", "phone: ", "call ", "fax ")}[kind])


_MAKERS = (_email, _ip, _card, _phone)


def labelled(n: int, seed: int) -> tuple[list[str], list[list[tuple[int, int, int]]]]:
    """``n`` texts of at most a window and their spans (kind, start, end)."""
    rng = random.Random(seed)
    texts, spans = [], []
    while len(texts) < n:
        text, found = "", []
        for _ in range(rng.randint(1, 14)):
            roll = rng.random()
            if roll < 0.16:
                kind = rng.randrange(len(KINDS))
                before, said, after = _secret(rng) if KINDS[kind] == "secret" else (rng.choice(("", "", "", _cue(rng, KINDS[kind]))), _MAKERS[kind](rng), "")
                text += before
                found.append((kind, len(text), len(text) + len(said)))
                text += said + after + rng.choice(("", "", ".", ",", ";", "!!"))
            elif roll < 0.32:
                text += _look_alike(rng)
            else:
                text += _word(rng)
            text += rng.choice((" ", " ", " ", " ", "\n"))
        cut = rng.choice((0, 0, rng.randint(0, 5)))  # windows begin anywhere
        text, found = text[cut:], [(k, a - cut, b - cut) for k, a, b in found]
        texts.append(text[:WINDOW])
        spans.append([(k, a, b) for k, a, b in found if a >= 0 and b <= WINDOW])
        if any(a < 0 or b > WINDOW for _, a, b in found):  # a cut span has no clear label
            texts.pop()
            spans.pop()
    return texts, spans


def _matrix(texts: list[str], spans: list[list[tuple[int, int, int]]]) -> tuple[np.ndarray, np.ndarray]:
    x, y = np.zeros((len(texts), WINDOW), np.uint8), np.zeros((len(texts), WINDOW), np.int64)
    for i, (text, some) in enumerate(zip(texts, spans, strict=True)):
        x[i, : len(text)] = classes(code_points(text))
        for kind, a, b in some:
            y[i, a:b], y[i, a] = 2 + 2 * kind, 1 + 2 * kind
    return x, y


# -- the network ----------------------------------------------------------------


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def _mask() -> np.ndarray:
    """0 where a transition may happen: an inside tag follows its own kind only."""
    allowed = np.zeros((TAGS, TAGS), np.float32)
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        allowed[:, inside] = _FORBIDDEN
        allowed[inside, inside] = allowed[inside - 1, inside] = 0
    return allowed


class Tagger:
    def __init__(self, seed: int = 10):
        rng = np.random.default_rng(seed)
        f = lambda *s: rng.normal(0, 1, s).astype(np.float32)
        h = HIDDEN
        bias = np.zeros((2, CLASSES, 4 * h), np.float32)
        bias[:, :, h : 2 * h] = 1  # gates: input, forget, output, candidate
        first = f(2, CLASSES, 4 * h)
        for group in _GROUPS:
            first[:, _ASCII[list(group)]] = first[:, _ASCII[[group[0]]]]
        self.inputs, self.recurrent = first * np.float32(0.3) + bias, f(2, h, 4 * h) * np.float32(0.5 / np.sqrt(h))
        self.out, self.out_bias = f(2 * h, TAGS) * np.float32(1 / np.sqrt(2 * h)), np.zeros(TAGS, np.float32)
        self.transitions, self.mask = np.zeros((TAGS, TAGS), np.float32), _mask()

    def weights(self) -> list[np.ndarray]:
        return [self.inputs, self.recurrent, self.out, self.out_bias, self.transitions]

    def _states(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Hidden states (windows, places, 2 * hidden) of both directions."""
        n, t_end = x.shape
        both = np.stack([x, x[:, ::-1]])
        h = np.zeros((2, n, HIDDEN), np.float32)
        c = np.zeros_like(h)
        states = np.empty((2, t_end, n, HIDDEN), np.float32)
        way = np.arange(2)[:, None]
        for t in range(t_end):
            z = self.inputs[way, both[:, :, t]] + h @ self.recurrent
            gates, g = _sigmoid(z[..., : 3 * HIDDEN]), np.tanh(z[..., 3 * HIDDEN :])
            i, f, o = gates[..., :HIDDEN], gates[..., HIDDEN : 2 * HIDDEN], gates[..., 2 * HIDDEN :]
            old, old_h = c, h
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            states[:, t] = h
            if keep is not None:
                keep.append((i, f, o, g, old, old_h, tc))
        return np.concatenate([states[0], states[1][::-1]], axis=-1).transpose(1, 0, 2)

    def tags(self, x: np.ndarray) -> np.ndarray:
        """The best tag sequence of each window (Viterbi)."""
        emit = self._states(x) @ self.out + self.out_bias
        move = self.transitions + self.mask
        n, t_end, _ = emit.shape
        score = emit[:, 0] + self.mask[0]
        back = np.empty((t_end, n, TAGS), np.int8)
        for t in range(1, t_end):
            every = score[:, :, None] + move
            back[t] = every.argmax(axis=1)
            score = every.max(axis=1) + emit[:, t]
        best = np.empty((n, t_end), np.int8)
        best[:, -1] = score.argmax(axis=1)
        for t in range(t_end - 1, 0, -1):
            best[:, t - 1] = back[t][np.arange(n), best[:, t]]
        return best

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        n, t_end = x.shape
        kept: list = []
        states = self._states(x, kept)
        emit = states @ self.out + self.out_bias
        # forward and backward sums as products of probabilities, scaled at each place
        step = np.exp(self.transitions + self.mask)
        likely = np.exp(emit - emit.max(axis=2, keepdims=True)).transpose(1, 0, 2)
        alpha, beta, scale = np.empty((t_end, n, TAGS), np.float32), np.ones((t_end, n, TAGS), np.float32), np.empty((t_end, n, 1), np.float32)
        alpha[0] = likely[0] * np.exp(self.mask[0])
        for t in range(t_end):
            if t:
                alpha[t] = (alpha[t - 1] @ step) * likely[t]
            scale[t] = alpha[t].sum(axis=1, keepdims=True)
            alpha[t] /= scale[t]
        for t in range(t_end - 2, -1, -1):
            beta[t] = ((likely[t + 1] * beta[t + 1]) @ step.T) / scale[t + 1]
        d_emit = (alpha * beta).transpose(1, 0, 2).copy()
        d_move = step * (alpha[:-1].reshape(-1, TAGS).T @ (likely * beta / scale)[1:].reshape(-1, TAGS))
        d_emit[np.arange(n)[:, None], np.arange(t_end)[None], y] -= 1
        np.add.at(d_move, (y[:, :-1].ravel(), y[:, 1:].ravel()), -1)
        d_move[self.mask != 0] = 0
        d_emit /= n
        d_states = d_emit @ self.out.T
        d_out = states.reshape(-1, 2 * HIDDEN).T @ d_emit.reshape(-1, TAGS)
        d_inputs, d_recurrent = np.zeros_like(self.inputs), np.zeros_like(self.recurrent)
        dh, dc = np.zeros((2, n, HIDDEN), np.float32), np.zeros((2, n, HIDDEN), np.float32)
        back = np.ascontiguousarray(self.recurrent.transpose(0, 2, 1))
        d_seen = np.empty((2, t_end, n, 4 * HIDDEN), np.float32)
        for t in range(t_end - 1, -1, -1):
            i, f, o, g, old, old_h, tc = kept[t]
            dh = dh + np.stack([d_states[:, t, :HIDDEN], d_states[:, t_end - 1 - t, HIDDEN:]])
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc * g * i * (1 - i), dc * old * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=-1)
            d_seen[:, t] = dz
            dh, dc = dz @ back, dc * f
        before = np.stack([k[5] for k in kept], axis=1)  # the hidden states each place begins with
        for way in range(2):
            d_recurrent[way] = before[way].reshape(-1, HIDDEN).T @ d_seen[way].reshape(-1, 4 * HIDDEN)
        for way, seen in ((0, x.T.ravel()), (1, x[:, ::-1].T.ravel())):
            order = np.argsort(seen, kind="stable")
            which, first = np.unique(seen[order], return_index=True)
            d_inputs[way][which] = np.add.reduceat(d_seen[way].reshape(len(seen), -1)[order], first)
        return [d_inputs, d_recurrent, d_out, d_emit.sum(axis=(0, 1)), d_move / n]

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 10) -> Tagger:
        rng = np.random.default_rng(seed)
        moments = [(np.zeros_like(w), np.zeros_like(w)) for w in self.weights()]
        step, total = 0, EPOCHS * -(-len(x) // BATCH)
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for at in range(0, len(x), BATCH):
                step += 1
                some = order[at : at + BATCH]
                grads = self._gradients(x[some], y[some])
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
                rate = RATE * min(1, 1.6 * (1 - step / (total + 1)))
                for w, g, (m, v) in zip(self.weights(), grads, moments, strict=True):
                    g = g * min(1, 5 / (norm + 1e-9))
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    w -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return self


def tag_spans(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, start, end) of each span in one window's tags."""
    spans, at = [], 0
    while at < len(tags):
        tag = int(tags[at])
        if tag % 2 == 1:
            end = at + 1
            while end < len(tags) and tags[end] == tag + 1:
                end += 1
            spans.append(((tag - 1) // 2, at, end))
            at = end
        else:
            at += 1
    return spans


@cache
def trained(seed: int = 10) -> Tagger:
    """The tagger, trained once in a process."""
    return Tagger(seed).fit(*_matrix(*labelled(SAMPLES, seed)), seed)
