"""A bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is the embedding of its letters and digits plus the mean embedding of its character n-grams (of the
UTF-8 bytes, marks included, with the word's ends marked), both from hashed tables.  Two gated recurrent layers read a
window of words in either direction; attention weighs the states, and a linear unit gives the
window's logit.  Training sees a text as the bag of its windows under one label.  A step draws some from all windows of
the text, one from every word, and the one with the highest logit stands for its bag.
"""

from __future__ import annotations

import numpy as np
import xxhash

from colloquy.llm.common import slices

GRAMS = (3, 4, 5)

#: Words whose n-grams are found at a time: few enough for a processor's own cache.
WORDS = 3_000

#: n-grams of a word that are added in turns with those of other words; the rest of a longer one is added at once.
TURNS = 96

#: Windows of a text that a step draws, and how often one more is a word of a text with label 0 over and over: repeating
#: an ordinary word doesn't change the label, but states drift far from those of prose on it.
DRAWN = 8
ECHOED = 0.25

MARKS = bytes(c for c in range(128) if not chr(c).isalnum())


def word_rows(words: list[bytes], size: int) -> np.ndarray:
    """Rows of the word table, by the words' letters and digits where they have any; row 0 is for padding."""
    plain = [w.translate(None, MARKS) or w for w in words]
    return (np.fromiter(map(xxhash.xxh3_64_intdigest, plain), np.uint64, len(plain)) % np.uint64(size - 1)).astype(np.int64) + 1


def gram_table(words: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the n-gram table, word by word, and where each word's begin and the last one's end; a word has one at least."""
    rows, counts = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
    for at in range(0, len(words), WORDS):
        part = words[at : at + WORDS]
        marked = b"<" + b"><".join(part) + b">"
        codes = np.frombuffer(marked, np.uint8).astype(np.uint64)
        lengths = np.fromiter(map(len, part), np.int64, len(part)) + 2
        ends = np.cumsum(lengths)
        word = np.repeat(np.arange(len(part)), lengths)
        found, owners = [], []
        for n in GRAMS:
            if len(codes) < n:
                continue
            total = np.full(len(codes) - n + 1, n, np.uint64)
            for i in range(n):
                total = total * np.uint64(0x100000001B3) + codes[i : len(codes) - n + 1 + i]
            total ^= total >> np.uint64(29)
            total *= np.uint64(0xBF58476D1CE4E5B9)
            inside = np.flatnonzero(np.arange(len(total)) + n <= ends[word[: len(total)]])
            found.append(((total[inside] >> np.uint64(24)) % np.uint64(size)).astype(np.int32))
            owners.append(word[inside])
        owners = np.concatenate(owners)
        rows.append(np.concatenate(found)[np.argsort(owners, kind="stable")])
        counts.append(np.bincount(owners, minlength=len(part)))
    return np.concatenate(rows), np.concatenate([[0], np.cumsum(np.concatenate(counts))])


def gram_means(table: np.ndarray, rows: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """The mean of each word's rows of the table."""
    n_words = len(turns) - 1
    out = np.empty((n_words, table.shape[1]), np.float32)
    for at in range(0, n_words, WORDS):
        own = turns[at : at + WORDS + 1]
        sums = np.add.reduceat(table[rows[own[0] : own[-1]]], own[:-1] - own[0], axis=0)
        out[at : at + WORDS] = sums / np.diff(own)[:, None].astype(np.float32)
    return out


def gram_means_by_turn(table: np.ndarray, rows: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """``gram_means``, adding the first rows of all words, then the second ones, and so on: faster, and rounded otherwise."""
    n_words = len(turns) - 1
    out = np.empty((n_words, table.shape[1]), np.float32)
    for at in range(0, n_words, WORDS):
        begin = turns[at : at + WORDS + 1]
        counts = np.diff(begin)
        order = np.argsort(-counts, kind="stable")  # those that still have rows stand first
        begin, falling = begin[order], -counts[order]
        sums = table[rows[begin]]
        n = len(order)
        for i in range(1, min(int(counts.max()), TURNS)):
            n = int(np.searchsorted(falling, -i))
            sums[:n] += table.take(rows[begin[:n] + i], axis=0)
        for k in range(int(np.searchsorted(falling, -TURNS))):
            sums[k] += table[rows[begin[k] + TURNS : begin[k] - falling[k]]].sum(axis=0)
        sums /= -falling[:, None].astype(np.float32)
        out[at + order] = sums
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    def __init__(self, d: int = 12, h: int = 8, words: int = 1 << 15, grams: int = 1 << 15, seed: int = 1):
        rng = np.random.default_rng(seed)
        draw = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
        self.h = h
        self.p = {"words": np.zeros((words, d), np.float32), "grams": draw(0.3, grams, d), "v": draw(0.3, 2 * h), "w": draw(0.3, 2 * h), "b": np.full(1, -1, np.float32)}
        for way in "fb":
            self.p[f"W{way}"], self.p[f"U{way}"], self.p[f"c{way}"] = draw(0.4, d, 3 * h), draw(0.3, h, 3 * h), np.zeros(3 * h, np.float32)
        self.seen = {k: np.full(v.shape, 1e-6, np.float32) for k, v in self.p.items()}

    def projected(self, words: list[bytes]) -> np.ndarray:
        """What windows need to know of the words: their inputs, and a one that takes the gates' biases."""
        grams = gram_means_by_turn(self.p["grams"], *gram_table(words, len(self.p["grams"])))
        out = np.ones((len(words), grams.shape[1] + 1), np.float32)
        np.add(self.p["words"][word_rows(words, len(self.p["words"]))], grams, out=out[:, :-1])
        return out

    def weights(self, way: str) -> np.ndarray:
        """From rows of ``projected`` to the gates of a layer."""
        return np.concatenate([self.p[f"W{way}"], self.p[f"c{way}"][None]])

    def layer(self, a: np.ndarray, mask: np.ndarray | None, way: str, keep: list | None = None) -> np.ndarray:
        """States (time, window, h) for gate inputs a (time, window, 3h)."""
        t_all, n, _ = a.shape
        h, u = self.h, self.p[f"U{way}"]
        states = np.empty((t_all, n, h), np.float32)
        state = np.zeros((n, h), np.float32)
        for t in range(t_all) if way == "f" else range(t_all - 1, -1, -1):
            g = state @ u
            zr = np.tanh((a[t, :, : 2 * h] + g[:, : 2 * h]) * np.float32(0.5))
            zr *= np.float32(0.5)
            zr += np.float32(0.5)
            z, r = zr[:, :h], zr[:, h:]
            new = np.tanh(a[t, :, 2 * h :] + r * g[:, 2 * h :])
            out = new + z * (state - new)
            if mask is not None:
                out = np.where(mask[t][:, None], out, state)
            if keep is not None:
                keep.append((t, state, z, r, new, g[:, 2 * h :]))
            states[t] = state = out
        return states

    def logits(self, x: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
        """Of windows, from rows of ``projected`` (time, window, d + 1)."""
        return self.logits_of_gates({way: x @ self.weights(way) for way in "fb"}, mask)

    def logits_of_gates(self, a: dict[str, np.ndarray], mask: np.ndarray | None) -> np.ndarray:
        states = np.concatenate([self.layer(a[way], mask, way) for way in "fb"], axis=2)
        return self.pooled(states, mask)[0]

    def every_logit(self, x: np.ndarray, length: int) -> np.ndarray:
        """Of the windows from every word of a row of words; x: rows of ``projected`` turned, words side by side in memory.

        A sigmoid is one over one plus an exponential, whose sign the weights take, so that gates divide; the attention's rows
        are in the matrix that gives the next step's gates.  The first step comes from an empty state, which leaves nothing
        to reset, and the last one gives no gates.  Few passes over short arrays: memory sets the pace.
        """
        n, h = x.shape[1] - length + 1, self.h
        e, q = np.empty((length, n), np.float32), np.empty((length, n), np.float32)
        g, state = np.empty((3 * h + 2, n), np.float32), np.empty((h, n), np.float32)
        z, zr, new, told = g[:h], g[: 2 * h], g[2 * h : 3 * h], g[3 * h :]
        sign = np.repeat(np.float32([-1, 1]), [2 * h, h])
        with np.errstate(over="ignore"):  # a gate that is shut divides by infinity
            for i, way in enumerate("fb"):
                u = np.concatenate([self.p[f"U{way}"].T * sign[:, None], self.p["v"][None, i * h : (i + 1) * h], self.p["w"][None, i * h : (i + 1) * h]])
                own = np.ascontiguousarray((self.weights(way) * sign).T) @ x
                steps = range(length) if way == "f" else range(length - 1, -1, -1)
                for t in steps:
                    at = own[:, t : t + n]
                    if t == steps[0]:
                        np.exp(at[:h], out=z)
                        z += 1
                        np.tanh(at[2 * h :], out=new)
                        np.divide(new, z, out=state)
                        np.subtract(new, state, out=state)
                    else:
                        zr += at[: 2 * h]
                        np.exp(zr, out=zr)
                        zr += 1
                        new /= g[h : 2 * h]
                        new += at[2 * h :]
                        np.tanh(new, out=new)
                        state -= new
                        state /= z
                        state += new
                    if t == steps[-1]:
                        np.matmul(u[3 * h :], state, out=told)
                    else:
                        np.matmul(u, state, out=g)
                    if i == 0:
                        e[t], q[t] = told
                    else:
                        e[t] += told[0]
                        q[t] += told[1]
        e -= e.max(axis=0)
        np.exp(e, out=e)
        q *= e
        return q.sum(axis=0) / e.sum(axis=0) + self.p["b"][0]

    def pooled(self, states: np.ndarray, mask: np.ndarray | None):
        e = states @ self.p["v"]
        if mask is not None:
            e = np.where(mask, e, np.float32(-30))
        e = np.exp(e - e.max(axis=0))
        e /= e.sum(axis=0)
        context = np.einsum("tn,tnh->nh", e, states)
        return context @ self.p["w"] + self.p["b"][0], e, context

    def gradients(self, x: np.ndarray, mask: np.ndarray, slope) -> tuple[dict, np.ndarray, np.ndarray]:
        """Of a loss whose slope by the logits is ``slope(logits)``; x: inputs (time, window, d)."""
        p, g, keeps = self.p, {}, {}
        a = {w: x @ p[f"W{w}"] + p[f"c{w}"] for w in "fb"}
        for w in "fb":
            keeps[w] = []
        states = np.concatenate([self.layer(a[w], mask, w, keeps[w]) for w in "fb"], axis=2)
        logits, e, context = self.pooled(states, mask)
        dz = slope(logits).astype(np.float32)
        g["w"], g["b"] = context.T @ dz, np.array([dz.sum()], np.float32)
        dcontext = dz[:, None] * p["w"]
        dstates = e[:, :, None] * dcontext[None]
        de = np.einsum("nh,tnh->tn", dcontext, states)
        de = e * (de - (e * de).sum(axis=0))
        g["v"] = np.einsum("tn,tnh->h", de, states)
        dstates += de[:, :, None] * p["v"]
        dx = np.zeros_like(x)
        for i, w in enumerate("fb"):
            u, h = p[f"U{w}"], self.h
            gu, da = np.zeros_like(u), np.zeros_like(a[w])
            carry = np.zeros((x.shape[1], h), np.float32)
            for t, before, z, r, new, s in reversed(keeps[w]):
                total = carry + dstates[t, :, i * h : (i + 1) * h]
                on = mask[t][:, None]
                live = total * on
                dnew = live * (1 - z) * (1 - new * new)
                dgate_z = live * (before - new) * z * (1 - z)
                dgate_r = dnew * s * r * (1 - r)
                ds = dnew * r
                gates = np.concatenate([dgate_z, dgate_r, ds], axis=1)
                da[t] = np.concatenate([dgate_z, dgate_r, dnew], axis=1)
                gu += before.T @ gates
                carry = total * ~on + live * z + gates @ u.T
            g[f"U{w}"] = gu
            g[f"W{w}"] = np.einsum("tnd,tng->dg", x, da)
            g[f"c{w}"] = da.sum(axis=(0, 1))
            dx += da @ p[f"W{w}"].T
        return g, dx, logits

    def update(self, key: str, gradient: np.ndarray, rate: float, rows: np.ndarray | None = None) -> None:
        """A step of Adagrad, on some rows of a table or on all of a matrix."""
        at = slice(None) if rows is None else rows
        self.seen[key][at] += gradient * gradient
        self.p[key][at] -= rate * gradient / np.sqrt(self.seen[key][at])


class Words:
    """What training looks up for numbered words: their rows of the word table and of the n-gram table."""

    def __init__(self, network: Network, words: list[bytes]):
        self.rows = word_rows(words, len(network.p["words"])).astype(np.int32)
        self.grams, self.turns = gram_table(words, len(network.p["grams"]))


def train(network: Network, texts: list[np.ndarray], words: Words, labels: np.ndarray, *, length: int, epochs: int, rate: float = 0.05, batch: int = 64, decay: float = 1e-3, smooth: float = 0.02, seed: int = 3) -> None:
    """Fits the network to whole texts (numbers of ``words``, none empty), each with a label."""
    rng = np.random.default_rng(seed)
    own_rows, grams, turns = words.rows, words.grams, words.turns
    counts = np.diff(turns)
    positive, negative = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    half = batch // 2

    def laid(chosen: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.full((length, len(chosen)), -1, np.int64)
        for i, x in enumerate(chosen):
            ids[: len(x), i] = x
        return ids, ids >= 0

    def gates_of(x: np.ndarray) -> dict[str, np.ndarray]:
        return {way: x @ network.p[f"W{way}"] + network.p[f"c{way}"] for way in "fb"}

    per_epoch = max(1, len(texts) // batch)
    for step in range(epochs * per_epoch):
        picked = np.concatenate([rng.choice(positive, half), rng.choice(negative, half)])
        if step % per_epoch == 0:
            x_all = None  # the last epoch's goes before this one's comes
            x_all = gram_means(network.p["grams"], grams, turns)
            for part in slices(len(x_all), WORDS):
                x_all[part] += network.p["words"][own_rows[part]]
        used = []
        for i in picked:
            drawn = rng.integers(0, max(1, len(texts[i]) - length + 1), DRAWN)
            used.append([texts[i][s : s + length] for s in np.unique(drawn)])
            if labels[i] == 0 and rng.random() < ECHOED:
                used[-1].append(np.full(length, rng.choice(texts[i]), texts[i].dtype))
        ids, mask = laid([w for u in used for w in u])
        z = network.logits_of_gates(gates_of(x_all[ids] * mask[:, :, None]), mask)
        best, at = [], 0
        for u in used:
            best.append(u[int(np.argmax(z[at : at + len(u)]))])
            at += len(u)
        ids, mask = laid(best)
        flat, back = np.unique(ids[mask], return_inverse=True)
        n_grams = counts[flat]
        touched = np.concatenate([grams[turns[w] : turns[w + 1]] for w in flat])
        owner = np.repeat(np.arange(len(flat)), n_grams)
        vectors = network.p["words"][own_rows[flat]] + gram_means(network.p["grams"], touched, np.concatenate([[0], np.cumsum(n_grams)]))
        x_all[flat] = vectors
        x = np.zeros((*ids.shape, vectors.shape[1]), np.float32)
        drop = rng.random(len(flat)) < 0.05
        x[mask] = (vectors * ~drop[:, None])[back]
        y = np.clip(labels[picked], smooth, 1 - smooth)
        g, dx, _ = network.gradients(x, mask, lambda s, y=y: (sigmoid(s) - y) / len(y))
        for key, value in g.items():
            network.update(key, value + (decay * 0.1 * network.p[key] if key[0] in "WUwv" else 0), rate)
        per_word = np.zeros_like(vectors)
        np.add.at(per_word, back, dx[mask])
        per_word *= ~drop[:, None]
        rows, spot = np.unique(own_rows[flat], return_inverse=True)
        gradient = np.zeros((len(rows), per_word.shape[1]), np.float32)
        np.add.at(gradient, spot, per_word)
        network.update("words", gradient + decay * 0.01 * network.p["words"][rows], rate, rows)
        rows, spot = np.unique(touched, return_inverse=True)
        share = (per_word / np.maximum(n_grams, 1)[:, None])[owner]
        gradient = np.empty((len(rows), per_word.shape[1]), np.float32)
        for d in range(per_word.shape[1]):
            gradient[:, d] = np.bincount(spot, weights=share[:, d], minlength=len(rows))
        network.update("grams", gradient, rate, rows)
