"""A gated recurrent language model in numpy with a class-factored softmax.

A text is a sequence of output numbers. Outputs are in contiguous classes, and the
probability of one is that of its class, given the state, times its probability within the
class. Texts run side by side in lanes, one after another in each, with the state set to
zero where a text begins and carried over everything else, so a text's log-likelihood is
that of the whole text. Training is truncated to windows of steps. Lanes are laid out a
bounded number of steps at a time.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

WINDOW = 24  # steps that gradients flow back
CHUNK = 32  # steps whose outputs are evaluated together when scoring
PIECE = 16 * WINDOW * 4  # steps laid out at a time; whole windows and whole chunks
BLOCK = 32_768  # parameters updated together, few enough for a core's own cache
SAFE = 60.0  # logits between -SAFE and SAFE need no shift before exp


def thirds(x: np.ndarray) -> np.ndarray:
    """The columns for the update gate, the reset gate and the new state, as three tables;
    those for the gates with the sign that they have in sigmoid's exp."""
    parts = x.reshape(len(x), 3, -1).transpose(1, 0, 2).copy()
    np.negative(parts[:2], out=parts[:2])
    return parts


def changes(x: np.ndarray) -> np.ndarray:
    """Places of a sorted vector where another value begins."""
    return np.append(np.zeros(min(len(x), 1), dtype=np.int64), np.flatnonzero(x[1:] != x[:-1]) + 1)


def exponentials(x: np.ndarray, starts: np.ndarray | None = None) -> np.ndarray | float:
    """exp in place, less a number per row that keeps it in range; that number. Rows are those
    of a table, or begin at `starts` of a vector."""
    shift: np.ndarray | float = 0.0
    if x.size and (x.max() > SAFE or x.min() < -SAFE):
        if starts is None:
            shift = x.max(axis=1)
            x -= shift[:, None]
        else:
            shift = np.maximum.reduceat(x, starts)
            x -= np.repeat(shift, np.diff(np.append(starts, x.size)))
    np.exp(x, out=x)
    return shift


@dataclass
class Lanes:
    """Texts laid out in lanes: at every step and lane the input, the wanted output, the
    text's number, and whether a text begins. Lanes are ordered by length, longest first."""

    inputs: np.ndarray
    wanted: np.ndarray
    text: np.ndarray
    begins: np.ndarray
    active: np.ndarray  # lanes still running, by step

    @classmethod
    def of(cls, texts: list[np.ndarray], start: int, lanes: int) -> Lanes:
        """All steps at once."""
        return next(cls.pieces(texts, start, lanes, max(1, sum(map(len, texts)))))

    @classmethod
    def pieces(
        cls, texts: list[np.ndarray], start: int, lanes: int, most: int | None = None
    ) -> Iterator[Lanes]:
        """At most `most` (PIECE) steps at a time, in order, with the lanes that still run, so
        memory does not follow the longest text. Every text goes to the shortest lane so far,
        the longest first. Without any token there is one piece of no steps."""
        most = most or PIECE
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        lanes = max(1, min(lanes, int((lengths > 0).sum())))
        filled = np.zeros(lanes, dtype=np.int64)
        members: list[list[int]] = [[] for _ in range(lanes)]
        import heapq

        heap = [(0, i) for i in range(lanes)]
        for i in np.argsort(-lengths, kind="stable"):
            if not lengths[i]:
                break
            total, lane = heapq.heappop(heap)
            members[lane].append(int(i))
            filled[lane] = total + lengths[i]
            heapq.heappush(heap, (int(filled[lane]), lane))
        order = np.argsort(-filled, kind="stable")
        places = [(0, 0)] * lanes  # of each column: the text it is at, and the tokens behind
        steps = int(filled.max(initial=0))
        for first in range(0, max(steps, 1), most):
            running = max(1, int((filled > first).sum()))
            shape = (min(most, steps - first), running)
            wanted = np.zeros(shape, dtype=np.int32)
            inputs = np.full(shape, start, dtype=np.int32)
            text = np.full(shape, -1, dtype=np.int64)
            begins = np.zeros(shape, dtype=bool)
            for column in range(running):
                own, (place, done), at = members[order[column]], places[column], 0
                while place < len(own) and at < shape[0]:
                    i = own[place]
                    n = min(int(lengths[i]) - done, shape[0] - at)
                    wanted[at : at + n, column] = texts[i][done : done + n]
                    fresh = int(done == 0)  # the first input of a text is the start
                    inputs[at + fresh : at + n, column] = texts[i][done + fresh - 1 : done + n - 1]
                    text[at : at + n, column] = i
                    begins[at, column] = fresh
                    at, done = at + n, done + n
                    if done == lengths[i]:
                        place, done = place + 1, 0
                places[column] = place, done
            yield cls(inputs, wanted, text, begins, (text >= 0).sum(axis=1))


def adam(g: np.ndarray, m: np.ndarray, v: np.ndarray, out: np.ndarray, step: float) -> np.ndarray:
    """Renews the moments m and v (as `train` keeps them) and returns, in `out`, what a
    gradient takes off its parameters. Overwrites the gradient."""
    if g.max() > 1 or g.min() < -1:
        np.clip(g, -1, 1, out=g)
    m *= 0.9
    m += g
    g *= g
    v *= 0.999
    v += g
    np.sqrt(v, out=out)
    out += 1e-8 * 1000**0.5
    np.divide(m, out, out=out)
    out *= step
    return out


class Late:
    """What Adam does to rows in rounds in which they have no gradient, all at once: moments
    fade by 0.9 and 0.999, and the row goes on by what is left of them. The small number in
    the denominator is taken as if it faded, too. Beyond MOST rounds nothing is left to go on by."""

    MOST = 400
    FADE = 0.9 / 0.999**0.5

    def __init__(self, rows: int):
        self.rounds, self.seen = 0, np.zeros(rows, dtype=np.int64)
        self.fades = self.FADE ** np.arange(self.MOST + 1)
        self.way = np.zeros(self.MOST + 1)  # of the last k rounds, by k

    def passed(self, step: float) -> None:
        """A round ended that went on by `step`."""
        self.rounds += 1
        self.way[1:] = self.way[:-1] + step * self.fades[1:]

    def caught_up(self, held: np.ndarray, m: np.ndarray, v: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
        """Brings `rows` of the parameters up to the rounds that have passed; their moments."""
        rounds = self.rounds - self.seen[rows]
        self.seen[rows] = self.rounds + 1  # the coming one has a gradient
        own_m, own_v = np.take(m, rows, axis=0), np.take(v, rows, axis=0)
        out = np.sqrt(own_v)
        out += 1e-8 * 1000**0.5
        np.divide(own_m, out, out=out)
        out *= self.way[np.minimum(rounds, self.MOST)].astype(out.dtype)[:, None]
        held[rows] -= out
        own_m *= np.exp(rounds * np.log(0.9)).astype(out.dtype)[:, None]
        own_v *= np.exp(rounds * np.log(0.999)).astype(out.dtype)[:, None]
        return [own_m, own_v]


class Work:
    """Arrays that a stretch of steps and lanes needs, kept for the next one of its shape."""

    def __init__(self, steps: int, lanes: int, size: int, kind: np.dtype, trains: bool):
        def room(*shape: int) -> np.ndarray:
            return np.empty(shape, dtype=kind)

        self.steps, self.lanes, self.size, self.kind, self.trains = steps, lanes, size, kind, trains
        kept = steps if trains else 1  # steps whose inner values are kept
        # The update gate, the reset gate and the new state's part stand one behind the other.
        self.projected, self.recurrent = room(3, steps, lanes, size), room(3, kept, lanes, size)
        self.h, self.carried = room(steps, lanes, size), room(steps, lanes, 1)
        self.gates, self.before = room(2, kept, lanes, size), room(kept, lanes, size)
        self.new = room(kept, lanes, size)
        if trains:
            self.x, self.d_states, self.spare = (room(steps, lanes, size) for _ in range(3))
            self.factors = room(4, steps, lanes, size)
            self.backs, self.back = room(3, lanes, size), room(lanes, size)

    @classmethod
    def of(cls, held: Work | None, shape: tuple[int, int], size: int, kind: np.dtype, trains: bool = True) -> Work:
        if held is None or (held.steps, held.lanes) != shape:
            return cls(*shape, size, kind, trains)
        return held

    def last(self) -> np.ndarray:
        """The states after the last step; not a part of the arrays that are used again."""
        return self.h[-1].copy()


@dataclass
class Rows:
    """Wanted outputs of a stretch in the order of outputs. `several` are the rows whose class
    has more than one output; `widths`, `starts`, `chosen` lay out a vector of all outputs of
    each such row's class, `firsts` are the first such rows of each class."""

    order: np.ndarray
    text: np.ndarray
    classes: np.ndarray
    several: np.ndarray
    widths: np.ndarray
    starts: np.ndarray
    chosen: np.ndarray
    firsts: np.ndarray
    states: np.ndarray


class Gru:
    """Parameters and their use. `bounds` are the first outputs of the classes and the end."""

    NAMES = ("embed", "wx", "wh", "b", "wc", "bc", "wo", "bo")

    def __init__(self, bounds: np.ndarray, weights: np.ndarray, size: int = 24, seed: int = 3):
        """Start from the outputs' frequencies: biases are their logarithms."""
        random = np.random.default_rng(seed)
        n, classes = int(bounds[-1]), len(bounds) - 1
        self.bounds = np.asarray(bounds, dtype=np.int64)

        def small(*shape: int) -> np.ndarray:
            return random.normal(0, 0.1, shape).astype(np.float32)

        self.embed, self.wx, self.wh = small(n, size), small(size, 3 * size), small(size, 3 * size)
        self.b = np.zeros(3 * size, dtype=np.float32)
        self.wc, self.wo = small(size, classes), small(n, size)
        mass = np.add.reduceat(weights, self.bounds[:-1])
        self.bc = np.log(mass / mass.sum()).astype(np.float32)
        self.bo = np.log(weights / np.repeat(mass, np.diff(self.bounds))).astype(np.float32)
        self.class_of = np.repeat(np.arange(classes), np.diff(self.bounds)).astype(np.int32)

    def pack(self) -> bytes:
        held = io.BytesIO()
        np.savez(held, bounds=self.bounds, **{k: getattr(self, k) for k in self.NAMES})
        return held.getvalue()

    @classmethod
    def unpack(cls, data: bytes) -> Gru:
        held = np.load(io.BytesIO(data))
        model = cls.__new__(cls)
        model.bounds = held["bounds"]
        for k in cls.NAMES:
            setattr(model, k, held[k])
        sizes = np.diff(model.bounds)
        model.class_of = np.repeat(np.arange(len(sizes)), sizes).astype(np.int32)
        return model

    @classmethod
    def mean(cls, packed: list[bytes], weights: list[float]) -> bytes:
        """The weighted mean of several models' parameters."""
        models = [cls.unpack(p) for p in packed]
        total = sum(weights)
        for k in cls.NAMES:
            parts = (getattr(m, k) * (w / total) for m, w in zip(models, weights, strict=True))
            setattr(models[0], k, sum(parts).astype(np.float32))
        return models[0].pack()

    def _joined(self) -> None:
        """Lays all parameters out in one vector, `flat`, of which the named ones are parts.
        A class's or an output's bias stands behind its weights."""
        n, size = self.embed.shape
        classes = len(self.bc)
        shapes = {
            "embed": (n, size), "wx": (size, 3 * size), "wh": (size, 3 * size), "b": (3 * size,),
            "classes": (size + 1, classes), "outputs": (n, size + 1),
        }
        lengths = [int(np.prod(shape)) for shape in shapes.values()]
        self.shapes = shapes
        flat = np.empty(sum(lengths), dtype=self.wh.dtype)
        named = self._named(flat)
        for k in self.NAMES:
            named[k][...] = getattr(self, k)
            setattr(self, k, named[k])
        self.flat, self.parts = flat, named

    def _named(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        """The parts of a vector that is laid out as the parameters are."""
        parts, at = {}, 0
        for k, shape in self.shapes.items():
            length = int(np.prod(shape))
            parts[k] = flat[at : at + length].reshape(shape)
            at += length
        size = self.shapes["wh"][0]
        parts["wc"], parts["bc"] = parts["classes"][:size], parts["classes"][size]
        parts["wo"], parts["bo"] = parts["outputs"][:, :size], parts["outputs"][:, size]
        return parts

    def _biased(self) -> tuple[np.ndarray, np.ndarray]:
        """Class and output weights with their biases as a last row, a last column."""
        return np.vstack([self.wc, self.bc]), np.hstack([self.wo, self.bo[:, None]])

    def _run(self, work: Work, laid: Lanes, at: int, h: np.ndarray, tables=None) -> None:
        """The states of the steps from `at` on that `work` holds, and what gradients need.
        All lanes that run at the first step go on to the last one; a step after a lane's end
        has the text -1. `tables`: the thirds of embed @ wx + b, if they are at hand."""
        size, w = h.shape[1], work
        inputs = laid.inputs[at : at + w.steps, : w.lanes].ravel()
        if tables is None:
            x = np.take(self.embed, inputs, axis=0, out=w.x.reshape(-1, size), mode="clip")
            biases = thirds(self.b[None])
            for weights, b, to in zip(thirds(self.wx), biases, w.projected, strict=True):
                np.matmul(x, weights, out=to.reshape(-1, size))
                to += b
        else:
            for table, to in zip(tables, w.projected, strict=True):
                np.take(table, inputs, axis=0, out=to.reshape(-1, size), mode="clip")
        np.logical_not(laid.begins[at : at + w.steps, : w.lanes, None], out=w.carried, casting="unsafe")
        wh = thirds(self.wh)
        with np.errstate(over="ignore"):  # exp to infinity, a gate of 0, as it should
            for t in range(w.steps):
                k = t if w.trains else 0
                before, gates, new, to = w.before[k], w.gates[:, k], w.new[k], w.h[t]
                recurrent = w.recurrent[:, k]
                np.multiply(h, w.carried[t], out=before)
                np.matmul(before, wh, out=recurrent)
                np.add(w.projected[:2, t], recurrent[:2], out=gates)
                np.exp(gates, out=gates)
                np.add(gates, 1, out=gates)
                np.reciprocal(gates, out=gates)
                np.multiply(gates[1], recurrent[2], out=new)
                np.add(new, w.projected[2, t], out=new)
                np.tanh(new, out=new)
                np.subtract(before, new, out=to)
                np.multiply(to, gates[0], out=to)
                h = np.add(to, new, out=to)

    def _rows(self, work: Work, laid: Lanes, at: int) -> Rows:
        """The outputs wanted at these steps, in the order of outputs, so of classes too."""
        wanted = laid.wanted[at : at + work.steps, : work.lanes].ravel()
        text = laid.text[at : at + work.steps, : work.lanes].ravel()
        order = np.argsort(wanted if len(self.class_of) > 65_535 else wanted.astype(np.uint16), kind="stable")
        if work.lanes and text[-work.lanes :].min() < 0:
            order = order[text[order] >= 0]
        wanted = wanted[order]
        classes = self.class_of[wanted]
        widths = (self.bounds[1:] - self.bounds[:-1])[classes]
        several = np.flatnonzero(widths > 1)
        widths = widths[several]
        starts = np.cumsum(widths) - widths
        firsts = changes(classes[several])
        states = np.empty((len(order), work.size + 1), dtype=work.kind)
        states[:, : work.size] = np.take(work.h.reshape(-1, work.size), order, axis=0)
        states[:, work.size] = 1  # meets the biases
        chosen = starts + (wanted - self.bounds[classes])[several]
        return Rows(order, text[order], classes, several, widths, starts, chosen, firsts, states)

    def _inner(self, rows: Rows, outputs: np.ndarray) -> tuple[np.ndarray, list]:
        """Logits of all outputs within the rows' classes, row after row, and for each class
        (first row, end, first output, end, its logits) as rows are counted in `several`."""
        inner = np.empty(int(rows.widths.sum()), dtype=outputs.dtype)
        states = rows.states[rows.several] if len(rows.several) < len(rows.order) else rows.states
        parts, firsts = [], rows.firsts
        bounds, begins = self.bounds.tolist(), firsts.tolist()
        ends, places = [*begins[1:], len(rows.several)], rows.starts[firsts].tolist()
        classes = rows.classes[rows.several[firsts]].tolist()
        for i, j, o, c in zip(begins, ends, places, classes, strict=True):
            a, b = bounds[c], bounds[c + 1]
            block = inner[o : o + (j - i) * (b - a)].reshape(j - i, b - a)
            np.matmul(states[i:j], outputs[a:b].T, out=block)
            parts.append((i, j, a, b, block))
        return inner, [states, parts]

    def log_likelihoods(self, texts: list[np.ndarray], start: int, lanes: int = 256) -> np.ndarray:
        """Natural logarithm of each whole text's probability; 0 for an empty sequence."""
        total = np.zeros(len(texts))
        kind = self.wh.dtype
        tables = thirds(self.embed @ self.wx + self.b)
        by_class, by_output = self._biased()
        ones = np.ones(len(self.bc), dtype=kind)
        h = np.zeros((max(1, min(lanes, len(texts))), self.wh.shape[0]), dtype=kind)
        work = None
        for laid in Lanes.pieces(texts, start, lanes):
            for at in range(0, len(laid.inputs), CHUNK):
                shape = min(CHUNK, len(laid.inputs) - at), int(laid.active[at])
                work = Work.of(work, shape, h.shape[1], kind, trains=False)
                self._run(work, laid, at, h[: shape[1]], tables)
                h = work.last()
                rows = self._rows(work, laid, at)
                logits = rows.states @ by_class
                found = logits[np.arange(len(logits)), rows.classes].astype(np.float64)
                found -= exponentials(logits)
                found -= np.log(logits @ ones)
                if len(rows.several):
                    inner, _ = self._inner(rows, by_output)
                    own = inner[rows.chosen].astype(np.float64)
                    own -= exponentials(inner, rows.starts)
                    found[rows.several] += own - np.log(np.add.reduceat(inner, rows.starts))
                total += np.bincount(rows.text, found, len(texts))
        return total

    def train(
        self, texts: list[np.ndarray], start: int, lanes: int = 64, rate: float = 0.02
    ) -> int:
        """One pass of truncated backpropagation with Adam; returns the tokens seen. What Adam does
        to a row of the embedding in windows that do not read it is made up for when it is
        next read, and at the end."""
        self._joined()
        gradient = np.zeros_like(self.flat)
        named = self._named(gradient)
        # Sums that fade by 0.9 and 0.999: 10 and 1000 times Adam's moments.
        first, second = np.zeros_like(gradient), np.zeros_like(gradient)
        m_named, v_named = self._named(first), self._named(second)
        spare = np.empty_like(gradient[:BLOCK])
        h = np.zeros((max(1, min(lanes, len(texts))), self.wh.shape[0]), dtype=self.wh.dtype)
        late = Late(len(self.embed))
        rounds = tokens = 0
        work = None
        for laid in Lanes.pieces(texts, start, lanes):
            tokens += int(laid.active.sum())
            for at in range(0, len(laid.inputs), WINDOW):
                shape = min(WINDOW, len(laid.inputs) - at), int(laid.active[at])
                work = Work.of(work, shape, h.shape[1], self.wh.dtype)
                self._reads(work, laid, at)
                read = work.read  # the only rows of the embedding with a gradient
                moments = late.caught_up(self.embed, m_named["embed"], v_named["embed"], read)
                self._gradients(work, laid, at, h[: shape[1]], named)
                h = work.last()
                rounds += 1
                slow = rate / (1 + rounds / 400)
                fix = np.sqrt(1 - 0.999**rounds) / (1 - 0.9**rounds)
                step = float(slow * fix * 0.1 * 1000**0.5)
                late.passed(step)
                g = np.take(named["embed"], read, axis=0)
                self.embed[read] -= adam(g, *moments, np.empty_like(g), step)
                m_named["embed"][read], v_named["embed"][read] = moments
                for a in range(self.embed.size, len(gradient), BLOCK):
                    part = slice(a, a + BLOCK)
                    g = gradient[part]
                    self.flat[part] -= adam(g, first[part], second[part], spare[: len(g)], step)
        late.caught_up(self.embed, m_named["embed"], v_named["embed"], np.arange(len(self.embed)))
        return tokens

    def _reads(self, work: Work, laid: Lanes, at: int) -> None:
        """The rows of the embedding that a window reads, and where."""
        read = laid.inputs[at : at + work.steps, : work.lanes].ravel()
        order = np.argsort(read if len(self.class_of) > 65_535 else read.astype(np.uint16), kind="stable")
        firsts = changes(read[order])
        work.read, work.read_order, work.read_firsts = read[order[firsts]], order, firsts

    def _window(self, laid: Lanes, steps: range, h: np.ndarray) -> tuple[np.ndarray, dict]:
        """States after the steps, and the gradients of their mean loss."""
        self._joined()
        gradient = self._named(np.zeros_like(self.flat))
        shape = len(steps), int(laid.active[steps[0]])
        work = Work.of(None, shape, h.shape[1], self.wh.dtype)
        self._reads(work, laid, steps[0])
        self._gradients(work, laid, steps[0], h[: shape[1]], gradient)
        return work.last(), {k: gradient[k] for k in self.NAMES}

    def _gradients(self, work: Work, laid: Lanes, at: int, h: np.ndarray, g: dict) -> None:
        """Writes the gradients of a window's mean loss to `g`; of the embedding, those of the
        rows that the window reads (`work.read`). Matrix products and sums are
        made once for all steps, but for those that carry the state and its gradient."""
        size, w = h.shape[1], work
        by_class, by_output = self.parts["classes"], self.parts["outputs"]
        self._run(w, laid, at, h)
        rows = self._rows(w, laid, at)
        n = len(rows.order)
        scale = 1.0 / n
        shares = rows.states @ by_class
        exponentials(shares)
        shares *= (scale / (shares @ np.ones(shares.shape[1], dtype=shares.dtype)))[:, None]
        shares[np.arange(n), rows.classes] -= scale
        np.matmul(rows.states.T, shares, out=g["classes"])
        d_rows = shares @ self.wc.T
        g["outputs"].fill(0)
        if len(rows.several):
            inner, (states, parts) = self._inner(rows, by_output)
            exponentials(inner, rows.starts)
            inner *= np.repeat(scale / np.add.reduceat(inner, rows.starts), rows.widths)
            inner[rows.chosen] -= scale
            d_inner = np.empty((len(states), size), dtype=inner.dtype)
            for i, j, a, b, block in parts:
                np.matmul(block.T, states[i:j], out=g["outputs"][a:b])
                np.matmul(block, self.wo[a:b], out=d_inner[i:j])
            if len(states) == n:
                d_rows += d_inner
            else:
                d_rows[rows.several] += d_inner
        d = w.d_states
        if n < w.steps * w.lanes:
            d.fill(0)
        d.reshape(-1, size)[rows.order] = d_rows
        z, r = w.gates
        # What a state's gradient is multiplied by for the new state, z, r, and the new state's
        # part of h @ wh; afterwards these gradients.
        factors, spare, kept = w.factors, w.spare, w.recurrent[2]
        np.subtract(1, z, out=spare)
        np.multiply(w.new, w.new, out=factors[0])
        np.subtract(1, factors[0], out=factors[0])
        factors[0] *= spare
        np.subtract(w.before, w.new, out=factors[1])
        factors[1] *= spare
        factors[1] *= z
        np.multiply(factors[0], r, out=factors[3])
        np.subtract(1, r, out=spare)
        spare *= kept
        np.multiply(factors[3], spare, out=factors[2])
        back, backs, wh_t = w.back, w.backs, self.wh.reshape(size, 3, size).transpose(1, 2, 0).copy()
        begun = laid.begins[at : at + w.steps, : w.lanes].any(axis=1).tolist()
        for t in range(w.steps - 1, -1, -1):
            here, parts = d[t], factors[:, t]
            if t < w.steps - 1:
                here += back
            np.multiply(parts, here, out=parts)
            np.matmul(parts[1:], wh_t, out=backs)
            np.multiply(here, z[t], out=back)
            back += backs[0]
            back += backs[1]
            back += backs[2]
            if begun[t]:
                back *= w.carried[t]
        x, before = w.x.reshape(-1, size).T, w.before.reshape(-1, size).T
        d_wx, d_wh = g["wx"].reshape(size, 3, size), g["wh"].reshape(size, 3, size)
        new, z, r, carried = factors.reshape(4, -1, size)
        ones = np.ones(x.shape[1], dtype=x.dtype)
        weights = self.wx.reshape(size, 3, size).transpose(1, 2, 0)
        d_embed = z @ weights[0]
        d_embed += r @ weights[1]
        d_embed += new @ weights[2]
        for k, own in enumerate((z, r, new)):
            d_wx[:, k] = x @ own
            g["b"][k * size : (k + 1) * size] = ones @ own
        for k, own in enumerate((z, r, carried)):
            d_wh[:, k] = before @ own
        g["embed"][w.read] = np.add.reduceat(np.take(d_embed, w.read_order, axis=0), w.read_firsts, axis=0)
