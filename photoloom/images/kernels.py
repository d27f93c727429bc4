"""Pixel kernels in NumPy: reduction, stacking, alignment, detection, photometry. Images are 2-D float arrays, y first."""

from __future__ import annotations

import numpy as np

SIGMA = 1.482602218505602


def trim(image: np.ndarray, left: int, right: int, bottom: int, top: int) -> np.ndarray:
    ny, nx = image.shape
    return image[bottom : ny - top, left : nx - right]


def deviation(image: np.ndarray, gain: float, read_noise: float) -> np.ndarray:
    """Standard deviation of each pixel from photon and read noise."""
    return np.sqrt(np.maximum(gain * image, 0) + read_noise**2) / gain


def clipped(values: np.ndarray, k: float = 3.0, rounds: int = 5) -> np.ndarray:
    """What sigma clipping about the median leaves of the finite values."""
    v = values[np.isfinite(values)]
    for _ in range(rounds):
        if not len(v):
            break
        m, s = np.median(v), v.std()
        keep = np.abs(v - m) <= k * s
        if keep.all():
            break
        v = v[keep]
    return v


def stack(images: np.ndarray, low: float = 5.0, high: float = 5.0, how: str = "mean") -> np.ndarray:
    """Pixel by pixel over the first axis, without values beyond ``low`` and ``high`` scaled deviations of the median."""
    m = np.nanmedian(images, axis=0)
    s = SIGMA * np.nanmedian(np.abs(images - m), axis=0)
    kept = np.where((images >= m - low * s) & (images <= m + high * s), images, np.nan)
    return {"mean": np.nanmean, "median": np.nanmedian, "sum": np.nansum}[how](kept, axis=0)


def master_flat(flats: np.ndarray) -> np.ndarray:
    return stack(flats / np.nanmedian(flats, axis=(1, 2), keepdims=True))


def reduce_frame(image: np.ndarray, exptime: float, bias: np.ndarray | None = None, dark: np.ndarray | None = None, dark_exptime: float | None = None, flat: np.ndarray | None = None, gain: float = 1.0, rate: bool = False) -> np.ndarray:
    """Bias, dark (scaled in time where the bias is gone), flat, gain, and electrons a second if asked."""
    out = image.astype(float)
    if bias is not None:
        out = out - bias
    if dark is not None:
        scale = exptime / dark_exptime if bias is not None and dark_exptime else 1.0
        out = out - (dark - (bias if bias is not None else 0)) * scale
    if flat is not None:
        out = out / (flat / np.nanmean(flat))
    out = out * gain
    return out / exptime if rate else out


def hot_pixels(dark: np.ndarray, share: float = 0.03, least: int = 2, most: int = 101) -> tuple[np.ndarray, int]:
    """Mask of hot pixels, and the smallest whole threshold that at most ``share`` of the pixels exceed."""
    for t in range(least, most + 1):
        if (dark > t).mean() <= share:
            return dark > t, t
    return dark > most, most


def block_average(image: np.ndarray, n: int) -> np.ndarray:
    ny, nx = (s // n * n for s in image.shape)
    return image[:ny, :nx].reshape(ny // n, n, nx // n, n).mean(axis=(1, 3))


def pad(image: np.ndarray, ny: int, nx: int, fill: float = 0.0) -> np.ndarray:
    return np.pad(image, ((0, ny - image.shape[0]), (0, nx - image.shape[1])), constant_values=fill)


def flip(image: np.ndarray) -> np.ndarray:
    """Half a turn, for frames from the other side of the pier."""
    return image[::-1, ::-1]


def shift_between(reference: np.ndarray, image: np.ndarray) -> tuple[int, int]:
    """Whole-pixel shift (dy, dx) that takes ``image`` onto ``reference``, by phase correlation."""
    a, b = (np.fft.rfft2(np.nan_to_num(x) - np.nanmedian(x)) for x in (reference, image))
    cross = a * np.conj(b)
    peak = np.fft.irfft2(cross / np.maximum(np.abs(cross), 1e-12), s=reference.shape)
    y, x = np.unravel_index(np.argmax(peak), peak.shape)
    ny, nx = peak.shape
    return int(y - ny if y > ny // 2 else y), int(x - nx if x > nx // 2 else x)


def shifted(image: np.ndarray, dy: float, dx: float) -> np.ndarray:
    """The image moved by (dy, dx), linear between pixels, NaN where nothing is known."""
    ny, nx = image.shape
    y, x = np.arange(ny)[:, None] - dy, np.arange(nx)[None, :] - dx
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = y - y0, x - x0
    padded = np.pad(image, 1, constant_values=np.nan)
    at = lambda j, i: padded[np.clip(j + 1, 0, ny + 1), np.clip(i + 1, 0, nx + 1)]
    out = np.zeros(image.shape)
    for j, wy in ((y0, 1 - fy), (y0 + 1, fy)):
        for i, wx in ((x0, 1 - fx), (x0 + 1, fx)):
            w = np.broadcast_to(wy * wx, image.shape)
            out = out + np.where(w > 0, w * at(j, i), 0.0)
    return out


def background(image: np.ndarray, mesh: int = 80, k: float = 5.0) -> tuple[np.ndarray, float]:
    """Sky of each mesh cell (clipped median, spread over its pixels) and the noise of what is left."""
    sky = np.empty_like(image, dtype=float)
    for y in range(0, image.shape[0], mesh):
        for x in range(0, image.shape[1], mesh):
            part = clipped(image[y : y + mesh, x : x + mesh], k)
            sky[y : y + mesh, x : x + mesh] = np.median(part) if len(part) else np.nan
    rest = clipped(image - sky, 3.0)
    return sky, float(SIGMA * np.median(np.abs(rest - np.median(rest)))) if len(rest) else 0.0


def _smooth(image: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Convolution by a kernel that is the product of its rows and columns."""
    out = np.apply_along_axis(np.convolve, 0, np.nan_to_num(image), kernel, "same")
    return np.apply_along_axis(np.convolve, 1, out, kernel, "same")


def find_stars(image: np.ndarray, fwhm: float = 4.0, threshold: float = 5.0) -> np.ndarray:
    """Columns x, y, peak of local maxima of the image smoothed to the star's width, above ``threshold`` times the noise."""
    sky, noise = background(image)
    s = fwhm / 2.354820045
    r = int(np.ceil(2 * s))
    kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / s) ** 2)
    kernel /= kernel.sum()
    smooth = _smooth(image - sky, kernel)
    level = threshold * noise * (kernel**2).sum()
    centre = smooth[1:-1, 1:-1]
    around = np.stack([smooth[1 + j : smooth.shape[0] - 1 + j, 1 + i : smooth.shape[1] - 1 + i] for j in (-1, 0, 1) for i in (-1, 0, 1) if (j, i) != (0, 0)])
    ys, xs = np.nonzero((centre > level) & (centre >= around.max(axis=0)))
    out = []
    for y, x in zip(ys + 1, xs + 1, strict=True):
        box = np.maximum((image - sky)[max(y - r, 0) : y + r + 1, max(x - r, 0) : x + r + 1], 0)
        if box.sum() > 0:
            jj, ii = np.mgrid[max(y - r, 0) : max(y - r, 0) + box.shape[0], max(x - r, 0) : max(x - r, 0) + box.shape[1]]
            out.append(((ii * box).sum() / box.sum(), (jj * box).sum() / box.sum(), smooth[y, x]))
    return np.array(out).reshape(-1, 3)


def aperture_photometry(image: np.ndarray, x: np.ndarray, y: np.ndarray, radius: float, inner: float, outer: float, gain: float = 1.0) -> np.ndarray:
    """Columns flux, error, sky of each position: the sum within ``radius`` less the clipped sky of the annulus."""
    out = np.full((len(x), 3), np.nan)
    r = int(np.ceil(outer))
    for k, (cx, cy) in enumerate(zip(x, y, strict=True)):
        x0, y0 = int(round(cx)), int(round(cy))
        jj, ii = np.mgrid[max(y0 - r, 0) : min(y0 + r + 1, image.shape[0]), max(x0 - r, 0) : min(x0 + r + 1, image.shape[1])]
        if not jj.size:
            continue
        part = image[jj[:, 0].min() : jj[:, 0].max() + 1, ii[0].min() : ii[0].max() + 1]
        d = np.hypot(ii - cx, jj - cy)
        # A pixel at the rim counts by how far it is inside.
        weight = np.clip(radius + 0.5 - d, 0, 1)
        ring = clipped(part[(d > inner) & (d <= outer)], 3.0, 10)
        if not len(ring):
            continue
        sky, area = np.median(ring), weight.sum()
        flux = np.nansum(part * weight) - sky * area
        out[k] = flux, np.sqrt(max(flux, 0) / gain + area * ring.var() * (1 + area / len(ring))), sky
    return out


def cosmic_rays(image: np.ndarray, noise: np.ndarray | float, contrast: float = 5.0, sigma: float = 4.5) -> np.ndarray:
    """Mask of cosmic rays: Laplacian edges on a doubled grid that stand out against noise and against the fine structure of
    stars (van Dokkum 2001)."""
    double = np.kron(np.nan_to_num(image), np.ones((2, 2)))
    p = np.pad(double, 1, mode="edge")
    lap = 4 * double - p[:-2, 1:-1] - p[2:, 1:-1] - p[1:-1, :-2] - p[1:-1, 2:]
    lap = block_average(np.maximum(lap, 0), 2)
    s = lap / (2 * noise)
    s = s - _median_filter(s, 5)
    fine = _median_filter(image, 3)
    fine = np.maximum((fine - _median_filter(fine, 7)) / noise, 0.01)
    return (s > sigma) & (s / fine > contrast)


def _median_filter(image: np.ndarray, n: int) -> np.ndarray:
    h = n // 2
    return np.median(np.lib.stride_tricks.sliding_window_view(np.pad(image, h, mode="edge"), (n, n)), axis=(2, 3))


def clean(image: np.ndarray, mask: np.ndarray, n: int = 5) -> np.ndarray:
    """Masked pixels replaced by the median of the good ones around."""
    h = n // 2
    holes = np.pad(np.where(mask, np.nan, image), h, constant_values=np.nan)
    out = image.astype(float).copy()
    for y, x in zip(*np.nonzero(mask), strict=True):
        around = holes[y : y + n, x : x + n]
        if np.isfinite(around).any():
            out[y, x] = np.nanmedian(around)
    return out


def _moved(stamp: np.ndarray, dy: float, dx: float) -> np.ndarray:
    """The stamp moved by parts of a pixel, exactly for a profile that the pixels sample well (phase shift)."""
    fy, fx = np.fft.fftfreq(stamp.shape[0])[:, None], np.fft.rfftfreq(stamp.shape[1])[None, :]
    return np.fft.irfft2(np.fft.rfft2(stamp) * np.exp(-2j * np.pi * (fy * dy + fx * dx)), s=stamp.shape)


def empirical_psf(image: np.ndarray, x: np.ndarray, y: np.ndarray, half: int = 6) -> np.ndarray:
    """Mean stamp of stars, each moved to the centre of a pixel and scaled to a sum of one."""
    stamps = []
    for cx, cy in zip(x, y, strict=True):
        x0, y0 = int(round(cx)), int(round(cy))
        part = image[max(y0 - half - 1, 0) : y0 + half + 2, max(x0 - half - 1, 0) : x0 + half + 2]
        if part.shape != (2 * half + 3, 2 * half + 3):
            continue
        rim = np.concatenate([part[0], part[-1], part[:, 0], part[:, -1]])
        stamp = _moved(part - np.median(rim), y0 - cy, x0 - cx)[1:-1, 1:-1]
        if np.isfinite(stamp).all() and stamp.sum() > 0:
            stamps.append(stamp / stamp.sum())
    if not stamps:
        raise ValueError("no star is far enough from the edges")
    psf = np.median(np.stack(stamps), axis=0)
    return psf / psf.sum()


def psf_photometry(image: np.ndarray, x: np.ndarray, y: np.ndarray, psf: np.ndarray, noise: float = 1.0, rounds: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Columns x, y, flux, error of stars whose profiles may overlap, and the residual image.

    All fluxes are one linear least-squares fit; between fits, positions move by the gradient of the profile. The sky must be
    taken off before.
    """
    half = psf.shape[0] // 2
    x, y = x.astype(float).copy(), y.astype(float).copy()
    ny, nx = image.shape

    def profile(cx: float, cy: float) -> tuple[slice, slice, np.ndarray]:
        x0, y0 = int(round(cx)), int(round(cy))
        stamp = _moved(np.pad(psf, 1), cy - y0, cx - x0)[1:-1, 1:-1]
        ys, xs = slice(max(y0 - half, 0), min(y0 + half + 1, ny)), slice(max(x0 - half, 0), min(x0 + half + 1, nx))
        return ys, xs, stamp[ys.start - y0 + half : ys.stop - y0 + half, xs.start - x0 + half : xs.stop - x0 + half]

    for k in range(rounds):
        fits = [profile(cx, cy) for cx, cy in zip(x, y, strict=True)]
        n = len(fits)
        normal, right = np.zeros((n, n)), np.zeros(n)
        model = np.zeros((n, ny, nx)) if n * ny * nx < 2e7 else None
        for i, (ys, xs, p) in enumerate(fits):
            right[i] = (p * image[ys, xs]).sum()
            if model is not None:
                model[i, ys, xs] = p
        for i, (ys, xs, p) in enumerate(fits):
            for j in range(n):
                if abs(x[i] - x[j]) <= 2 * half + 2 and abs(y[i] - y[j]) <= 2 * half + 2:
                    other = model[j, ys, xs] if model is not None else _overlap(fits[j], ys, xs)
                    normal[i, j] = (p * other).sum()
        normal += 1e-12 * np.eye(n)
        flux = np.linalg.solve(normal, right) if n else right
        residual = image.astype(float).copy()
        for f, (ys, xs, p) in zip(flux, fits, strict=True):
            residual[ys, xs] -= f * p
        if k == rounds - 1:
            break
        for i, (ys, xs, p) in enumerate(fits):
            if flux[i] <= 0 or min(p.shape) < 3:
                continue
            gy, gx = np.gradient(p)
            a = np.stack([-flux[i] * gx.ravel(), -flux[i] * gy.ravel()], axis=1)
            step = np.linalg.lstsq(a, residual[ys, xs].ravel(), rcond=None)[0]
            x[i], y[i] = x[i] + np.clip(step[0], -0.5, 0.5), y[i] + np.clip(step[1], -0.5, 0.5)
    error = noise * np.sqrt(np.diag(np.linalg.inv(normal))) if n else np.zeros(0)
    return np.stack([x, y, flux, error], axis=1), residual


def _overlap(fit, ys: slice, xs: slice) -> np.ndarray:
    """The profile of ``fit`` on another window."""
    out = np.zeros((ys.stop - ys.start, xs.stop - xs.start))
    fy, fx, p = fit
    a, b, c, d = max(ys.start, fy.start), min(ys.stop, fy.stop), max(xs.start, fx.start), min(xs.stop, fx.stop)
    if a < b and c < d:
        out[a - ys.start : b - ys.start, c - xs.start : d - xs.start] = p[a - fy.start : b - fy.start, c - fx.start : d - fx.start]
    return out


def similarity_transform(reference: np.ndarray, points: np.ndarray, brightest: int = 20, tolerance: float = 2.0) -> np.ndarray | None:
    """The 2 x 3 matrix of turn, scale and shift that takes ``points`` onto ``reference`` (columns x, y, brightness), or None.

    Triangles of the brightest stars are matched by the ratios of their sides; the transform of the pair that brings most points
    onto reference stars is refitted to all of these.
    """
    a, b = (p[np.argsort(-p[:, 2])][:brightest, :2] for p in (reference, points))
    if len(a) < 3 or len(b) < 3:
        return None

    def triangles(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = np.hypot(*(p[:, None] - p[None]).transpose(2, 0, 1))
        near = np.argsort(d, axis=1)[:, 1:6]
        sets = sorted({tuple(sorted((i, j, k))) for i in range(len(p)) for j in near[i] for k in near[i] if len({i, j, k}) == 3})
        corners, shapes = [], []
        for i, j, k in sets:
            sides = sorted(((d[j, k], i), (d[i, k], j), (d[i, j], k)))
            if sides[2][0] > 0:
                corners.append([s[1] for s in sides])
                shapes.append((sides[0][0] / sides[2][0], sides[1][0] / sides[2][0]))
        return np.array(corners).reshape(-1, 3), np.array(shapes).reshape(-1, 2)

    def fit(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
        s, t = src[:, 0] + 1j * src[:, 1], dst[:, 0] + 1j * dst[:, 1]
        ds, dt = s - s.mean(), t - t.mean()
        w = (np.conj(ds) * dt).sum() / max((np.abs(ds) ** 2).sum(), 1e-12)
        shift = t.mean() - w * s.mean()
        return np.array([[w.real, -w.imag, shift.real], [w.imag, w.real, shift.imag]])

    def inliers(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        moved = b @ m[:, :2].T + m[:, 2]
        d = np.hypot(*(moved[:, None] - a[None]).transpose(2, 0, 1))
        j = d.argmin(axis=1)
        ok = d[np.arange(len(b)), j] <= tolerance
        return np.flatnonzero(ok), j[ok]

    (ca, sa), (cb, sb) = triangles(a), triangles(b)
    best, most = None, 2
    for corners, shape in zip(cb, sb, strict=True):
        if not len(sa):
            break
        for k in np.argsort(((sa - shape) ** 2).sum(axis=1))[:3]:
            m = fit(b[corners], a[ca[k]])
            i, _ = inliers(m)
            if len(i) > most:
                best, most = m, len(i)
    if best is None:
        return None
    for _ in range(3):
        i, j = inliers(best)
        best = fit(b[i], a[j])
    return best


def limited_shift(reference: np.ndarray, image: np.ndarray, most: int = 1000) -> tuple[int, int]:
    """As ``shift_between``, of shifts of at most ``most`` pixels along either axis (no shift at all is not looked for)."""
    a, b = (np.fft.rfft2(np.nan_to_num(x - np.nanmedian(x))) for x in (reference, image))
    cross = a * np.conj(b)
    peak = np.fft.irfft2(cross / np.maximum(np.abs(cross), 1e-12), s=reference.shape)
    dy, dx = (np.minimum(np.arange(n), n - np.arange(n)) for n in peak.shape)
    peak = np.where((dy[:, None] <= most) & (dx[None, :] <= most), peak, -np.inf)
    peak[0, 0] = -np.inf
    y, x = np.unravel_index(np.argmax(peak), peak.shape)
    ny, nx = peak.shape
    return int(y - ny if y > ny // 2 else y), int(x - nx if x > nx // 2 else x)


def limiting_flux(image: np.ndarray, mask: np.ndarray, radius: float, *, apertures: int = 500, sigmas: float = 5.0, rounds: int = 2, seed: int = 1) -> float:
    """The flux that stands out from the sky by ``sigmas``: the scatter of the sums of apertures that are strewn over the sky
    without meeting each other or the mask; the mean of ``rounds`` of them. NaN where no three apertures find a place."""
    ny, nx = image.shape
    reach = int(np.ceil(radius))
    jj, ii = np.mgrid[-reach : reach + 1, -reach : reach + 1]
    disc = np.hypot(jj, ii) <= radius
    taken = np.cumsum(np.cumsum(np.pad(mask | ~np.isfinite(image), ((1, 0), (1, 0))).astype(np.int64), axis=0), axis=1)
    w = 2 * reach + 1
    free = (taken[w:, w:] - taken[:-w, w:] - taken[w:, :-w] + taken[:-w, :-w]) == 0 if min(ny, nx) >= w else np.zeros((0, 0), bool)
    places = np.argwhere(free) + reach
    limits = []
    for k in range(rounds):
        rng = np.random.default_rng(seed + k)
        used, sums = np.zeros((ny, nx), bool), []
        for y, x in rng.permutation(places):
            box = (slice(y - reach, y + reach + 1), slice(x - reach, x + reach + 1))
            if not used[box][disc].any():
                used[box] |= disc
                sums.append(image[box][disc].sum())
                if len(sums) == apertures:
                    break
        if len(sums) > 2:
            limits.append(sigmas * np.std(sums))
    return float(np.mean(limits)) if limits else float("nan")


def pad_masked(image: np.ndarray, mask: np.ndarray, error: np.ndarray, ny: int, nx: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Image, mask and error on a larger plane: what is added is 0, masked, without error."""
    return pad(image, ny, nx), pad(mask.astype(float), ny, nx, 1.0).astype(bool), pad(error, ny, nx)


def plain_mask(flat: np.ndarray, low: float = 6.0, high: float = 6.0, box: int = 7) -> np.ndarray:
    """Bad pixels of a ratio of flats: those that stand out from the median around by more than the scaled deviation allows."""
    off = flat - _median_filter(flat, box)
    s = SIGMA * np.nanmedian(np.abs(off - np.nanmedian(off)))
    return ~((off >= -low * max(s, 1e-12)) & (off <= high * max(s, 1e-12)))
