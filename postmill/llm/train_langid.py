"""Training of the language network: python -m postmill.llm.train_langid JOBS.parquet [PAGES] [STEPS].

Lines and titles of a bounded sample (PAGES, 5400 by default) are labelled with the record's declared
language, which is wrong for some; a second round relabels those that the first round's network
reads confidently otherwise.
"""

from __future__ import annotations

import re
import sys

import numpy as np

from postmill.llm.langid import LANGUAGES, WEIGHTS, Network, named, prepared

HIDDEN, EMBED = 16, 12


def start(rng: np.random.Generator) -> dict[str, np.ndarray]:
    g = lambda *s: rng.normal(0, 1, s) / np.sqrt(s[-2] if len(s) > 1 else 1)
    p = {"emb": rng.normal(0, 0.5, (256, EMBED)), "w": g(2, EMBED, 3 * HIDDEN), "b": np.zeros((2, 1, 3 * HIDDEN)),
         "u": g(2, HIDDEN, 3 * HIDDEN), "v": g(2, HIDDEN, len(LANGUAGES)) * 0.5, "c": np.zeros(len(LANGUAGES))}
    return {k: v.astype(np.float32) for k, v in p.items()}


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def loss_and_gradient(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy of every position of windows x (batch, time; no padding) and its gradient through time."""
    n, t = x.shape
    h = HIDDEN
    both = np.stack((x, x[:, ::-1]))
    e = p["emb"][both]  # 2, n, t, E
    a = np.matmul(e.reshape(2, n * t, EMBED), p["w"]).reshape(2, n, t, 3 * h) + p["b"][:, None]
    s = np.zeros((2, t + 1, n, h), dtype=np.float32)
    kept = []
    for i in range(t):
        g = np.matmul(s[:, i], p["u"])
        z = sigmoid(a[:, :, i, :h] + g[:, :, :h])
        r = sigmoid(a[:, :, i, h : 2 * h] + g[:, :, h : 2 * h])
        c = np.tanh(a[:, :, i, 2 * h :] + r * g[:, :, 2 * h :])
        s[:, i + 1] = c + z * (s[:, i] - c)
        kept.append((g[:, :, 2 * h :], z, r, c))
    ahead, behind = s[0, 1:], s[1, 1:][::-1]
    logits = ahead @ p["v"][0] + behind @ p["v"][1] + p["c"]  # t, n, L
    logits -= logits.max(axis=2, keepdims=True)
    prob = np.exp(logits)
    prob /= prob.sum(axis=2, keepdims=True)
    loss = float(-np.log(prob[:, np.arange(n), y] + 1e-9).mean())
    d = prob
    d[:, np.arange(n), y] -= 1
    d /= n * t
    grad = {"c": d.sum(axis=(0, 1)), "v": np.stack((np.tensordot(ahead, d, ((0, 1), (0, 1))), np.tensordot(behind, d, ((0, 1), (0, 1)))))}
    ds = np.stack((d @ p["v"][0].T, (d @ p["v"][1].T)[::-1]))  # 2, t, n, h
    da = np.zeros_like(a)
    du = np.zeros_like(p["u"])
    carry = np.zeros((2, n, h), dtype=np.float32)
    ut = p["u"].transpose(0, 2, 1)
    for i in range(t - 1, -1, -1):
        gc, z, r, c = kept[i]
        dh = ds[:, i] + carry
        dz = dh * (s[:, i] - c) * z * (1 - z)
        dc = dh * (1 - z) * (1 - c * c)
        dr = dc * gc * r * (1 - r)
        dg = np.concatenate((dz, dr, dc * r), axis=2)
        da[:, :, i] = np.concatenate((dz, dr, dc), axis=2)
        du += np.matmul(s[:, i].transpose(0, 2, 1), dg)
        carry = dh * z + np.matmul(dg, ut)
    grad["u"] = du
    grad["b"] = da.sum(axis=(1, 2))[:, None]
    flat = da.reshape(2, n * t, 3 * h)
    grad["w"] = np.matmul(e.reshape(2, n * t, EMBED).transpose(0, 2, 1), flat)
    de = np.matmul(flat, p["w"].transpose(0, 2, 1)).reshape(-1, EMBED)
    grad["emb"] = np.zeros_like(p["emb"])
    np.add.at(grad["emb"], both.reshape(-1), de)
    return loss, grad


def strange_names(rng: np.random.Generator, lines: list[str], y: np.ndarray) -> list[bytes]:
    """The lines with names from anywhere: a name says nothing about the language around it.

    Inside a line, capitalised words are names except in German; a third of them are exchanged for
    names of other lines, and in German some are put in.
    """
    german = LANGUAGES.index("de")
    pool = [w for s, k in zip(lines, y) if k != german for w in re.findall(r"(?<=[a-zà-ÿ] )[A-ZÀ-Ý][\w'’-]+", s)]
    pick = iter(rng.integers(0, len(pool), 40 * len(lines) + 1)) if pool else iter(())
    name = lambda: pool[next(pick, 0)] if pool else ""
    out = []
    for s, k in zip(lines, y):
        if k != german:
            s = re.sub(r"(?<=[\w,] )[A-ZÀ-Ý][\w'’-]+", lambda m: name() if rng.random() < 0.35 else m[0], s)
        elif rng.random() < 0.4:
            s = re.sub(r"(?<!\w)((?:in|um|bei|von|nach|mit|für) )([A-ZÀ-Ý][\w'’-]+)", lambda m: m[1] + (name() if rng.random() < 0.5 else m[2]), s)
        if rng.random() < 0.15:
            s = f"{name()} {s[:1].lower()}{s[1:]}" if rng.random() < 0.5 else f"{s} {name()}"
        out.append(prepared(s))
    return out


def fit(lines: list[bytes], y: np.ndarray, steps: int, p: dict[str, np.ndarray] | None = None, seed: int = 3, rate: float = 0.006) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    p = p or start(rng)
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    by = [np.nonzero(y == k)[0] for k in range(len(LANGUAGES))]
    by = [b for b in by if len(b)]
    for step in range(1, steps + 1):
        # Every language alike often; windows of one length, from lines at least that long.
        t = int(rng.choice((16, 24, 40, 64)))
        pick = np.concatenate([rng.choice(b, 256 // len(by)) for b in by])
        pick = [i for i in pick if len(lines[i]) >= t]
        if len(pick) < 32:
            continue
        x = np.stack([np.frombuffer(lines[i], dtype=np.uint8)[(o := rng.integers(0, len(lines[i]) - t + 1)) : o + t] for i in pick])
        loss, g = loss_and_gradient(p, x, y[pick])
        norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
        lr = rate * (0.1 + 0.9 * (1 - step / steps))
        for k in p:
            a = g[k] * min(1.0, 1.0 / (norm + 1e-9))
            m[k] += 0.1 * (a - m[k])
            v[k] += 0.005 * (a * a - v[k])
            p[k] -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.995**step)) + 1e-8)).astype(np.float32)
        if step % 200 == 0:
            print(f"step {step}: loss {loss:.4f}", flush=True)
    return p


def network(p: dict[str, np.ndarray]) -> Network:
    return Network(*packed(p))


def packed(p: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    return np.matmul(p["emb"][None], p["w"]) + p["b"], p["u"], p["v"], p["c"]


def main(path: str, most: int = 5400, steps: int = 5000) -> None:
    import pyarrow.parquet as pq

    from postmill.llm import pages

    t = pq.read_table(path, columns=["description_text", "title", "lang_label"]).to_pydict()
    rows = [r for r in zip(t["description_text"], t["title"], t["lang_label"]) if r[0] and r[0].strip() and named(r[2]) in LANGUAGES][: most + 500]
    reader, lines, y, held = pages.load(), [], [], []
    for at in range(0, len(rows), 256):
        part = rows[at : at + 256]
        for i, ((text, name, lab), found) in enumerate(zip(part, pages.furniture(reader, [r[0] for r in part], [r[1] for r in part]))):
            split, k = text.split("\n"), LANGUAGES.index(named(lab))
            into = lines if at + i < most else held
            for s in [name or "", *(split[n - 1] for n, q in found if q < 0.5)]:
                if len(prepared(s)) >= 16:
                    into.append(s)
                    y.append(k)
    y = np.array(y)
    gold, y = y[len(lines) :], y[: len(lines)]
    print(len(lines), "lines", np.bincount(y), flush=True)
    rng = np.random.default_rng(1)
    p = fit(strange_names(rng, lines, y), y, steps)
    for again in range(2):
        net = network(p)
        z = np.exp(np.concatenate([net.read(lines[a : a + 20000]) for a in range(0, len(lines), 20000)]))
        other = (z.argmax(1) != y) & (z.max(1) > 0.8)
        print("relabelled", int(other.sum()), "of", len(y), flush=True)
        y = np.where(other, z.argmax(1), y)
        p = fit(strange_names(rng, lines, y), y, steps, p, seed=4 + again, rate=0.004)
    table, u, v, c = packed(p)
    np.savez_compressed(WEIGHTS, table=table.astype(np.float16), u=u.astype(np.float16), v=v.astype(np.float16), c=c.astype(np.float16))
    z = Network.load().read(held)
    print("held-out lines", len(held), "agreement with the declared language", float((z.argmax(1) == gold).mean()), flush=True)


if __name__ == "__main__":
    main(sys.argv[1], *map(int, sys.argv[2:4]))
