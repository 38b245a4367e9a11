"""Per-image kernels by numpy, for Arrow batches of bounded images."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

WINDOWS = ("ram-lak", "shepp-logan", "cosine", "hamming", "hann")


def ramp(n: int, window: str = "ram-lak") -> np.ndarray:
    """The frequency response of a reconstruction filter for rows of n samples."""
    size = max(64, 1 << (2 * n - 1).bit_length())
    f = np.abs(np.fft.fftfreq(size)) * 2
    shape = {
        "ram-lak": np.ones(size), "shepp-logan": np.sinc(f / 2), "cosine": np.cos(f * np.pi / 2),
        "hamming": 0.54 + 0.46 * np.cos(f * np.pi), "hann": 0.5 + 0.5 * np.cos(f * np.pi),
    }
    return f * shape[window]


def filtered_back_projection(sinogram: np.ndarray, degrees: np.ndarray, window: str = "ram-lak") -> np.ndarray:
    """An n x n slice from (angles, n) rows, scaled by pi / 2 / angles."""
    angles, n = sinogram.shape
    response = ramp(n, window)
    rows = np.fft.ifft(np.fft.fft(sinogram, len(response), axis=1) * response, axis=1).real[:, :n]
    y, x = np.mgrid[:n, :n] - (n - 1) / 2
    out = np.zeros((n, n))
    for row, a in zip(rows, np.radians(degrees), strict=True):
        t = x * np.cos(a) + y * np.sin(a) + (n - 1) / 2
        low = np.clip(np.floor(t).astype(int), 0, n - 2)
        w = t - low
        out += np.where((t >= 0) & (t <= n - 1), row[low] * (1 - w) + row[low + 1] * w, 0)
    return out * np.pi / 2 / angles


@lru_cache(64)
def _rays(n: int, degrees: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each voxel of an n x n slice: the lower sample of its ray, the weight of the upper one, and whether it is met."""
    y, x = np.mgrid[:n, :n].reshape(2, -1) - (n - 1) / 2
    t = x * np.cos(np.radians(degrees)) + y * np.sin(np.radians(degrees)) + (n - 1) / 2
    low = np.clip(np.floor(t).astype(int), 0, n - 2)
    return low, t - low, (t >= 0) & (t <= n - 1)


def smear(image: np.ndarray, degrees: float) -> np.ndarray:
    """(slices, n * n): one projection of (slices, n) samples, its rows ramp-filtered, spread along its rays."""
    n = image.shape[1]
    response = ramp(n, "hann")
    rows = np.fft.ifft(np.fft.fft(image, len(response), axis=1) * response, axis=1).real[:, :n]
    low, w, met = _rays(n, degrees)
    return (rows[:, low] * (1 - w) + rows[:, low + 1] * w) * met


def reproject(volume: np.ndarray, degrees: float) -> np.ndarray:
    """(slices, n): the sums of (slices, n * n) voxels along rays, adjoint to the spreading."""
    n = int(np.sqrt(volume.shape[1]))
    low, w, met = _rays(n, degrees)
    return np.array([np.bincount(low, v * met * (1 - w), n) + np.bincount(low + 1, v * met * w, n) for v in volume])


def turned(image: np.ndarray, dy, dx) -> np.ndarray:
    """The transform of the image shifted by (dy, dx), wrapping; or of each of a stack, shifted by its own."""
    fy, fx = (np.fft.fftfreq(n) for n in image.shape[-2:])
    turn = lambda f, d: np.exp(-2j * np.pi * np.multiply.outer(d, f))
    return np.fft.fft2(image) * turn(fy, dy)[..., :, None] * turn(fx, dx)[..., None, :]


def moved(image: np.ndarray, dy, dx) -> np.ndarray:
    """The image shifted by (dy, dx), wrapping, through its transform; or each of a stack by its own."""
    return np.fft.ifft2(turned(image, dy, dx)).real


def high_pass(image: np.ndarray, width: float = 0.05) -> np.ndarray:
    """The image, or each of a stack, without frequencies far below ``width`` cycles a pixel."""
    f2 = sum(g * g for g in np.meshgrid(*(np.fft.fftfreq(n) for n in image.shape[-2:]), indexing="ij"))
    return np.fft.ifft2(np.fft.fft2(image) * (1 - np.exp(-f2 / (2 * width * width)))).real


def gradient_shift(model: np.ndarray, image: np.ndarray) -> tuple:
    """(dy, dx) by which ``image``, or each of a stack, lies from ``model`` to first order: least squares on the model's gradient; 0 where it is flat."""
    out = []
    for g in np.gradient(model):
        power = float((g * g).sum())
        met = (g * (image - model)).sum(axis=(-2, -1))
        out.append(-met / power if power > 0 else np.zeros_like(met))
    return out[0], out[1]


def shift_between(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """(dy, dx) by which ``b`` lies from ``a``: the peak of the cross-correlation, refined by its centre of mass."""
    c = np.abs(np.fft.ifft2(np.conj(np.fft.fft2(a - a.mean())) * np.fft.fft2(b - b.mean())))
    peak = np.unravel_index(np.argmax(c), c.shape)
    out = []
    for axis, at in enumerate(peak):
        n = c.shape[axis]
        near = [(at + o) % n for o in (-1, 0, 1)]
        w = np.array([c[(k, peak[1]) if axis == 0 else (peak[0], k)] for k in near])
        w = w - w.min()
        place = at + (w[2] - w[0]) / max(w.sum(), 1e-300)
        out.append(place - n if place > n / 2 else place)
    return float(out[0]), float(out[1])


def fit_peak(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> np.ndarray:
    """a, b, c, d, e, f of a * exp(-((x - b) / c)^2) + d * x^-e + f by damped least squares, c kept positive, e in [0, 4]."""
    top = int(np.argmax(y))
    p = np.array([y[top] - y.min(), x[top], (x[-1] - x[0]) / 6, 0.1, 1.0, y.min()], float)

    def model(p):
        return p[0] * np.exp(-(((x - p[1]) / p[2]) ** 2)) + p[3] * x ** -p[4] + p[5]

    def bounded(p):
        return np.array([p[0], min(max(p[1], x[0]), x[-1]), max(p[2], 1e-3), p[3], min(max(p[4], 0.0), 4.0), p[5]])

    damp, cost = 1e-2, float(((model(p) - y) ** 2).sum())
    for _ in range(rounds):
        r = model(p) - y
        j = np.stack([(model(p + h) - model(p)) / 1e-6 for h in np.eye(6) * 1e-6], 1)
        a = j.T @ j
        try:
            new = bounded(p - np.linalg.solve(a + damp * (np.diag(np.diag(a)) + 1e-9 * np.eye(6)), j.T @ r))
        except np.linalg.LinAlgError:  # some parameters have no say here, and the damping has become too small to tell
            damp = max(damp * 1e3, 1e-12)
            continue
        value = float(((model(new) - y) ** 2).sum())
        if value < cost:
            done = cost - value < 1e-12 * (1 + cost)
            p, cost, damp = new, value, damp / 3
            if done:
                break
        else:
            damp *= 4
    return p


def shell_correlation(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """|sum F1 F2*| / sqrt(sum |F1|^2 sum |F2|^2) by ring of integer frequency."""
    fa, fb = np.fft.fftn(a), np.fft.fftn(b)
    grid = np.meshgrid(*(np.fft.fftfreq(n, 1 / n) for n in a.shape), indexing="ij")
    ring = np.round(np.sqrt(sum(g * g for g in grid))).astype(int).ravel()
    total = lambda v: np.bincount(ring, v.ravel())
    cross = total((fa * fb.conj()).real) + 1j * total((fa * fb.conj()).imag)
    return np.abs(cross) / np.sqrt(np.maximum(total(np.abs(fa) ** 2) * total(np.abs(fb) ** 2), 1e-300))


def integrated(dx: np.ndarray, dy: np.ndarray) -> np.ndarray:
    """The image of mean zero whose differences along both axes are nearest to ``dx`` (rows, n - 1) and ``dy`` (m - 1, n).

    The Poisson equation with free edges is diagonal in the even extension of
    the image, which one transform of twice the size gives.
    """
    m, n = dx.shape[0], dy.shape[1]
    source = np.zeros((m, n))
    source[:, :-1] += dx
    source[:, 1:] -= dx
    source[:-1] += dy
    source[1:] -= dy
    even = np.concatenate([source, source[::-1]], axis=0)
    even = np.concatenate([even, even[:, ::-1]], axis=1)
    wave = (2 * np.cos(np.pi * np.arange(2 * m) / m) - 2)[:, None] + (2 * np.cos(np.pi * np.arange(2 * n) / n) - 2)[None, :]
    wave[0, 0] = 1
    spectrum = np.fft.fft2(even) / wave
    spectrum[0, 0] = 0
    return np.fft.ifft2(spectrum).real[:m, :n]
