"""Fits the tagger of ``pii`` in numpy: ``python -m lumenframe.llm.pii_train DOCUMENTS.parquet ... --minutes 16``.

The labelled spans are those of ``pii_labels`` on a bounded sample of the documents (``--docs``), with names, digits and
street words partly replaced by invented ones. A tenth of the sample is held out to measure exact spans.
"""

from __future__ import annotations

import argparse
import random
import time

import numpy as np
import pyarrow.dataset as ds

from lumenframe.llm import pii, pii_labels

STEPS, BATCH, EMB, HIDDEN = 128, 128, 24, 48


def new_model(rng: np.random.Generator) -> dict[str, np.ndarray]:
    init = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    model = {"emb": 0.5 * rng.standard_normal((pii.VOCABULARY, EMB)).astype(np.float32), "out": init(2 * HIDDEN, pii.TAGS), "out_b": np.zeros(pii.TAGS, np.float32), "trans": np.zeros((pii.TAGS, pii.TAGS), np.float32), "start": np.zeros(pii.TAGS, np.float32)}
    for d in "fb":
        bias = np.zeros(4 * HIDDEN, np.float32)
        bias[HIDDEN : 2 * HIDDEN] = 1
        model |= {f"{d}_wx": init(EMB, 4 * HIDDEN), f"{d}_wh": init(HIDDEN, 4 * HIDDEN), f"{d}_b": bias}
    return model


def lstm(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, tuple]:
    steps, n, _ = x.shape
    k = wh.shape[0]
    zx = x.reshape(steps * n, -1) @ wx + b
    zx = zx.reshape(steps, n, 4 * k)
    hs, cs, gs, tc = (np.empty((steps, n, w), np.float32) for w in (k, k, 4 * k, k))
    h = c = np.zeros((n, k), np.float32)
    for t in range(steps):
        z = zx[t] + h @ wh
        z[:, : 3 * k] = 0.5 * (np.tanh(0.5 * z[:, : 3 * k]) + 1)
        z[:, 3 * k :] = np.tanh(z[:, 3 * k :])
        c = z[:, k : 2 * k] * c + z[:, :k] * z[:, 3 * k :]
        tc[t] = np.tanh(c)
        h = z[:, 2 * k : 3 * k] * tc[t]
        hs[t], cs[t], gs[t] = h, c, z
    return hs, (x, hs, cs, gs, tc)


def lstm_back(dh_all: np.ndarray, cache: tuple, wx: np.ndarray, wh: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    x, hs, cs, gs, tc = cache
    steps, n, k = hs.shape
    dz_all = np.empty((steps, n, 4 * k), np.float32)
    dh, dc = np.zeros((n, k), np.float32), np.zeros((n, k), np.float32)
    for t in range(steps - 1, -1, -1):
        i, f, o, g = gs[t, :, :k], gs[t, :, k : 2 * k], gs[t, :, 2 * k : 3 * k], gs[t, :, 3 * k :]
        dh = dh + dh_all[t]
        dc = dc + dh * o * (1 - tc[t] ** 2)
        before = cs[t - 1] if t else 0.0
        dz = dz_all[t]
        dz[:, :k] = dc * g * i * (1 - i)
        dz[:, k : 2 * k] = dc * before * f * (1 - f)
        dz[:, 2 * k : 3 * k] = dh * tc[t] * o * (1 - o)
        dz[:, 3 * k :] = dc * i * (1 - g**2)
        dh, dc = dz @ wh.T, dc * f
    flat = dz_all.reshape(steps * n, -1)
    return (flat @ wx.T).reshape(x.shape), x.reshape(steps * n, -1).T @ flat, hs[:-1].reshape(-1, k).T @ dz_all[1:].reshape(-1, 4 * k), flat.sum(0)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def crf(scores: np.ndarray, tags: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Mean negative log likelihood of the tags and its gradients."""
    steps, n, k = scores.shape
    alpha, beta = np.empty_like(scores), np.zeros_like(scores)
    alpha[0] = start + scores[0]
    for t in range(1, steps):
        alpha[t] = _lse(alpha[t - 1][:, :, None] + trans, 1) + scores[t]
    for t in range(steps - 2, -1, -1):
        beta[t] = _lse(trans + (scores[t + 1] + beta[t + 1])[:, None, :], 2)
    z = _lse(alpha[-1], 1)
    marginal = np.exp(alpha + beta - z[None, :, None])
    pair = np.zeros((k, k), np.float64)
    for t in range(1, steps):
        pair += np.exp(alpha[t - 1][:, :, None] + trans + (scores[t] + beta[t])[:, None, :] - z[:, None, None]).sum(0)
    hot = np.eye(k, dtype=np.float32)[tags]
    gold = np.zeros((k, k))
    np.add.at(gold, (tags[:-1].ravel(), tags[1:].ravel()), 1)
    score = (scores * hot).sum() + (trans * gold).sum() + start[tags[0]].sum()
    return float(z.sum() - score) / n, (marginal - hot) / n, ((pair - gold) / n).astype(np.float32), (marginal[0] - hot[0]).sum(0) / n


def gradients(model: dict[str, np.ndarray], codes: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    x = model["emb"][codes]
    hf, cf = lstm(x, model["f_wx"], model["f_wh"], model["f_b"])
    hb, cb = lstm(x[::-1], model["b_wx"], model["b_wh"], model["b_b"])
    h = np.concatenate([hf, hb[::-1]], 2)
    loss, ds_, dtrans, dstart = crf(h @ model["out"] + model["out_b"], tags, model["trans"], model["start"])
    flat = ds_.reshape(-1, pii.TAGS).astype(np.float32)
    g = {"out": h.reshape(len(flat), -1).T @ flat, "out_b": flat.sum(0), "trans": dtrans, "start": dstart.astype(np.float32)}
    dh = (flat @ model["out"].T).reshape(h.shape)
    dx, g["f_wx"], g["f_wh"], g["f_b"] = lstm_back(dh[:, :, :HIDDEN], cf, model["f_wx"], model["f_wh"])
    back, g["b_wx"], g["b_wh"], g["b_b"] = lstm_back(dh[::-1, :, HIDDEN:], cb, model["b_wx"], model["b_wh"])
    dx = dx + back[::-1]
    g["emb"] = np.zeros_like(model["emb"])
    np.add.at(g["emb"], codes.ravel(), dx.reshape(-1, EMB))
    return loss, g


def window(text: str, spans: list, rng: random.Random) -> tuple[np.ndarray, np.ndarray]:
    """One window of STEPS characters, more often around a span than elsewhere; short texts are padded."""
    if spans and rng.random() < 0.8:
        _, s, e = rng.choice(spans)
        first = s - rng.randint(0, max(0, STEPS - min(e - s, STEPS)))
    else:
        first = rng.randint(0, max(0, len(text) - STEPS))
    first = max(0, min(first, len(text) - STEPS))
    cut = [(k, s, e) for k, s, e in spans if e > first - 200 and s < first + STEPS + 200]
    low, high = max(0, first - 200), min(len(text), first + STEPS + 200)
    cut = [(k, s - low, e - low) for k, s, e in cut if s >= low and e <= high]
    piece, moved = pii_labels.vary(text[low:high], cut, rng)
    codes, tags = np.zeros(STEPS, np.int64), np.zeros(STEPS, np.int64)
    first = min(first - low, max(0, len(piece) - STEPS))
    found = pii.encode(piece)[first : first + STEPS]
    codes[: len(found)] = found
    for kind, s, e in moved:
        k = pii.KINDS.index(kind)
        a, z = s - first, min(e - first, STEPS)
        if z <= 0 or a >= STEPS:
            continue
        tags[max(a, 0) : z] = 2 + 2 * k
        if a >= 0:
            tags[a] = 1 + 2 * k
    return codes, tags


def measure(model: dict[str, np.ndarray], texts: list[str]) -> dict[str, tuple[int, int, int]]:
    """(labelled, found, both) exact spans by kind."""
    out = {k: [0, 0, 0] for k in pii.KINDS}
    for t, got in zip(texts, pii.find(texts, model), strict=True):
        want, got = set(pii_labels.label(t)), set(got)
        for k in pii.KINDS:
            a, b = {x for x in want if x[0] == k}, {x for x in got if x[0] == k}
            out[k] = [out[k][0] + len(a), out[k][1] + len(b), out[k][2] + len(a & b)]
    return {k: tuple(v) for k, v in out.items()}


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__)
    args.add_argument("documents", nargs="+")
    args.add_argument("--docs", type=int, default=24_000, help="most documents that are labelled")
    args.add_argument("--minutes", type=float, default=12)
    args.add_argument("--seed", type=int, default=1)
    args.add_argument("--out", default=pii.MODEL_FILE)
    args.add_argument("--start", help="model file to go on from")
    args.add_argument("--rate", type=float, default=4e-3, help="largest step size")
    args.add_argument("--rich", type=float, default=0.75, help="share of windows from texts with spans")
    a = args.parse_args()
    rng = random.Random(a.seed)
    texts = sorted({t for p in a.documents for t in ds.dataset(p).to_table(columns=["text"])["text"].to_pylist() if t})
    rng.shuffle(texts)
    texts = texts[: a.docs]
    held, texts = texts[: len(texts) // 10], texts[len(texts) // 10 :]
    data = [(t, pii_labels.label(t)) for t in texts]
    rich = [x for x in data if x[1]]
    print(len(data), "texts,", len(rich), "with spans", flush=True)
    model = pii.load_model(a.start) if a.start else new_model(np.random.default_rng(a.seed))
    m, v = ({k: np.zeros_like(w) for k, w in model.items()} for _ in range(2))
    began, step, smooth = time.time(), 0, None
    while (share := (time.time() - began) / 60 / a.minutes) < 1:
        pairs = [window(*(rng.choice(rich) if rng.random() < a.rich else rng.choice(data)), rng) for _ in range(BATCH)]
        codes, tags = (np.stack(z, 1) for z in zip(*pairs, strict=True))
        loss, g = gradients(model, codes, tags)
        norm = np.sqrt(sum(float((x**2).sum()) for x in g.values()))
        rate = a.rate * min(1, (step + 1) / 50) * (0.02 + 0.98 * 0.5 * (1 + np.cos(np.pi * share)))
        step += 1
        for k in model:
            x = g[k] * min(1.0, 5.0 / max(norm, 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * x
            v[k] = 0.99 * v[k] + 0.01 * x * x
            model[k] = (model[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        smooth = loss if smooth is None else 0.98 * smooth + 0.02 * loss
        if step % 200 == 0:
            print(step, round(smooth, 3), round((time.time() - began) / 60, 1), flush=True)
            if step % 1000 == 0:
                print(measure(model, held[:400]), flush=True)
                np.savez_compressed(a.out, **{k: w.astype(np.float16) for k, w in model.items()})
    np.savez_compressed(a.out, **{k: w.astype(np.float16) for k, w in model.items()})
    print("held out", measure(pii.load_model(a.out), held), flush=True)


if __name__ == "__main__":
    main()
