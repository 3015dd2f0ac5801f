"""Small images for tests, and plain loops that say what each pass must do."""

from __future__ import annotations

import random
from collections import deque

COLS = ["frame", "x", "y", "r", "g", "b", "a"]


def to_df(spark, images: dict):
    """``images[frame][y][x] = (r, g, b, a)`` as pixel rows."""
    rows = [(f, x, y, *px) for f, img in images.items() for y, line in enumerate(img) for x, px in enumerate(line)]
    schema = "frame bigint, x bigint, y bigint, r bigint, g bigint, b bigint, a bigint"
    return spark.createDataFrame(rows, schema).repartition("frame")


def from_df(df) -> dict:
    out: dict = {}
    for r in df.select(*COLS).collect():
        out.setdefault(r.frame, {})[(r.x, r.y)] = (r.r, r.g, r.b, r.a)
    return {f: [[cells[(x, y)] for x in range(max(k[0] for k in cells) + 1)] for y in range(max(k[1] for k in cells) + 1)] for f, cells in out.items()}


def random_images(n, w, h, colours=4, alphas=(0, 255), seed=1, p_clear=0.5):
    rng = random.Random(seed)
    palette = [tuple(rng.randrange(256) for _ in range(3)) for _ in range(colours)]

    def px():
        a = rng.choice([v for v in alphas if v]) if rng.random() > p_clear else 0
        return (*rng.choice(palette), a)

    return {f: [[px() for _ in range(w)] for _ in range(h)] for f in range(n)}


def mean_block(img, k):
    out = []
    for oy in range(len(img) // k):
        line = []
        for ox in range(len(img[0]) // k):
            block = [(dx, dy, img[oy * k + dy][ox * k + dx]) for dy in range(k) for dx in range(k)]
            total = sum(p[3] for _, _, p in block)
            if total == 0:
                line.append((0, 0, 0, 0))
                continue
            rgb = [int(sum(p[c] * p[3] for _, _, p in block) / total + 0.5) for c in range(3)]
            quotient, rest = divmod(2 * total, k * k)
            if rest == 0 and quotient % 2 == 1:
                lean_x = sum(p[3] * (2 * dx - k + 1) for dx, _, p in block)
                lean_y = sum(p[3] * (2 * dy - k + 1) for _, dy, p in block)
                alpha = total // (k * k) + (1 if lean_x > 0 or (lean_x == 0 and lean_y > 0) else 0)
            else:
                alpha = int(total / (k * k) + 0.5)
            line.append((*rgb, alpha))
        out.append(line)
    return out


def common_block(img, k):
    out = mean_block(img, k)
    for oy, line in enumerate(out):
        for ox, (r, g, b, a) in enumerate(line):
            if a == 0:
                continue
            block = [(dx, dy, img[oy * k + dy][ox * k + dx]) for dy in range(k) for dx in range(k)]
            drawn = [s for s in block if s[2][3] == 254]
            solid = [s for s in block if s[2][3] not in (0, 254)]
            voters = drawn if 2 * len(drawn) >= k * k or not solid else solid
            votes: dict = {}
            for dx, dy, p in voters:
                d = (2 * dx - k + 1) ** 2 + (2 * dy - k + 1) ** 2
                n, near, first = votes.get(p[:3], (0, d, dy * k + dx))
                votes[p[:3]] = (n + 1, min(near, d), first)
            best = min(votes, key=lambda c: (-votes[c][0], votes[c][1], votes[c][2]))
            line[ox] = (*best, a)
    return out


def spread_colours(img):
    """Breadth-first flood from the opaque pixels in scan order."""
    h, w = len(img), len(img[0])
    out = [list(line) for line in img]
    seen = [[p[3] != 0 for p in line] for line in img]
    queue = deque((x, y) for y in range(h) for x in range(w) if seen[y][x])
    while queue:
        x, y = queue.popleft()
        for nx, ny in ((x, y - 1), (x - 1, y), (x + 1, y), (x, y + 1)):
            if 0 <= nx < w and 0 <= ny < h and not seen[ny][nx]:
                seen[ny][nx] = True
                out[ny][nx] = (*out[y][x][:3], out[ny][nx][3])
                queue.append((nx, ny))
    return out


def ring(img, side, width, connectivity, colour):
    h, w = len(img), len(img[0])
    solid = lambda x, y: 0 <= x < w and 0 <= y < h and img[y][x][3] != 0
    out = [list(line) for line in img]
    for y in range(h):
        for x in range(w):
            near = False
            for dy in range(-width, width + 1):
                for dx in range(-width, width + 1):
                    far = max(abs(dx), abs(dy)) if connectivity == 8 else abs(dx) + abs(dy)
                    if 0 < far <= width and solid(x + dx, y + dy) == (side == "outside"):
                        near = True
            if near and solid(x, y) == (side == "inside"):
                out[y][x] = (*colour, 255)
    return out


def tidy(img, mode, least):
    h, w = len(img), len(img[0])
    out = [list(line) for line in img]
    for y in range(h):
        for x in range(w):
            if img[y][x][3] == 0:
                continue
            around = [img[b][a][:3] for a, b in ((x, y - 1), (x - 1, y), (x + 1, y), (x, y + 1)) if 0 <= a < w and 0 <= b < h and img[b][a][3]]
            if mode == "remove" and len(around) < least:
                out[y][x] = (0, 0, 0, 0)
            if mode == "recolour" and len(around) >= 3 and img[y][x][:3] not in around:
                best = min(set(around), key=lambda c: (-around.count(c), c))
                out[y][x] = (*best, img[y][x][3])
    return out


def regions(img):
    h, w = len(img), len(img[0])
    left = {(x, y) for y in range(h) for x in range(w) if img[y][x][3]}
    count = 0
    while left:
        count += 1
        stack = [left.pop()]
        while stack:
            x, y = stack.pop()
            for q in [(x + dx, y + dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]:
                if q in left:
                    left.remove(q)
                    stack.append(q)
    return count
