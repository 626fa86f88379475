"""Operators by name: run("avg", array, flags)."""

from __future__ import annotations

from .frame import bitmask, flag_dims
from .operators import algorithms, calibration, contract, elementwise, generate, index, kernels, linops, models, neural, nlops, noncartesian, prox, recon, reduce, signals, window
from .sources import arrays

VERSION = "0.2.0"

OPERATORS = {
    "bitmask": bitmask, "bitmask_dims": flag_dims,
    "zeros": generate.zeros, "ones": generate.ones, "vec": generate.vec, "delta": generate.delta, "index": generate.index, "poly": generate.poly, "upat": generate.upat, "grid": generate.grid, "traj": generate.traj, "raga": generate.raga, "phantom": generate.phantom, "signal": generate.signal_flash, "noise": generate.noise,
    "slice": index.slice_, "extract": index.extract, "flip": index.flip, "circshift": index.circshift, "fftshift": index.fftshift, "transpose": index.transpose, "reshape": index.reshape, "flatten": index.flatten, "squeeze": index.squeeze, "resize": index.resize, "crop": index.crop, "repmat": index.repmat, "join": index.join, "casorati": index.casorati, "calmat": index.calmat, "permute": index.permute, "pad": index.pad, "compare": index.compare, "shuffle": index.shuffle_blocks, "decompose": index.decompose, "compress": index.compress, "decompress": index.decompress, "copy": index.copy_into,
    "calc": elementwise.calc, "cabs": elementwise.cabs, "carg": elementwise.carg, "conj": elementwise.conj, "creal": elementwise.creal, "cpyphs": elementwise.cpyphs, "zexp": elementwise.zexp, "scale": elementwise.scale, "spow": elementwise.spow, "invert": elementwise.invert, "saxpy": elementwise.saxpy, "fftmod": elementwise.fftmod, "window": elementwise.window_taper, "normalize": elementwise.normalize, "threshold": elementwise.soft_threshold, "threshold_hard": elementwise.hard_threshold, "threshold_binary": elementwise.binary_threshold, "threshold_top_k": elementwise.top_k_mask, "looklocker": elementwise.looklocker, "fovshift": elementwise.fovshift,
    "sum": reduce.total, "avg": reduce.avg, "var": reduce.var, "std": reduce.std, "rss": reduce.rss, "mip": reduce.mip, "pattern": reduce.pattern, "sdot": reduce.sdot, "nrmse": reduce.nrmse, "measure": reduce.measure, "roistat": reduce.roistat, "hist": reduce.hist, "onehotenc": reduce.onehotenc, "onehotdec": reduce.onehotdec,
    "fmac": contract.fmac, "matmul": contract.matmul, "conv": contract.conv, "cc": contract.cc, "ccapply": contract.apply_matrix, "whiten": contract.whiten,
    "filter_average": window.moving_average, "filter_median": window.moving_median, "cumsum": window.cumsum, "forward_difference": window.forward_difference, "backward_difference": window.backward_difference, "unwrap": window.unwrap, "bin": window.bin_labels, "bin_reorder": window.reorder, "ssa_gram": window.hankel_gram, "morphop": window.morph, "morphop_open": window.morph_open, "morphop_close": window.morph_close,
    "fft": kernels.fft, "cdf97": kernels.cdf97, "wavelet": kernels.wavelet, "fftrot": kernels.fftrot, "svd": kernels.svd, "nlmeans": kernels.nlmeans, "rof": kernels.rof, "nudft": kernels.nudft, "svthresh": kernels.singular_threshold,
    "gmm": models.gmm, "gmm_sample": models.gmm_sample, "mandelbrot": models.mandelbrot, "conway": models.conway, "pol2mask": models.pol2mask, "estdims": models.estdims, "trajcor": models.trajcor, "pulse": models.pulse, "bloch": models.bloch, "toraw": models.toraw, "interpolate": models.interpolate, "fakeksp": models.fakeksp, "psf": models.psf, "wavepsf": models.wavepsf, "rmfreq": models.rmfreq, "estscaling": models.estscaling,
    "pics": recon.pics, "itsense": recon.itsense, "pocsense": recon.pocsense, "denoise": recon.denoise, "tgv": recon.tgv, "lrmatrix": recon.lrmatrix, "caldir": recon.caldir, "ecalib": recon.ecalib, "estvar": recon.estvar, "rovir": recon.rovir, "homodyne": recon.homodyne, "estshift": recon.estshift, "poisson": recon.poisson, "mobafit": recon.mobafit, "epg": recon.epg, "pics_penalties": recon.pics_penalties, "ictv": recon.ictv,
    "coils": calibration.coils, "walsh": calibration.walsh, "ecaltwo": calibration.ecaltwo, "phasepole": calibration.phasepole, "nlinv": calibration.nlinv, "ncalib": calibration.ncalib, "rtnlinv": calibration.rtnlinv, "sake": calibration.sake, "wave": calibration.wave, "moba": calibration.moba, "estdelay": calibration.estdelay, "affinereg": calibration.affinereg, "estmotion": calibration.estmotion, "sample": calibration.sample_posterior,
    "nufft": noncartesian.nufft, "nufft_adjoint": noncartesian.nufft_adjoint, "nufft_inverse": noncartesian.nufft_inverse, "nufftbase": noncartesian.nufftbase, "grog": noncartesian.grog,
    "nnet_fit": neural.fit, "nnet_apply": neural.apply, "threshold_wavelet": prox.wavelet_soft, "threshold_largest": prox.largest, "threshold_low_rank": lambda a, level, flags, block=8: kernels.blockwise(a, flags, lambda x: recon.low_rank_blocks(x, level, block, tuple(i for i in range(min(3, x.ndim))))),
    "sim": signals.simulate, "show": arrays.show, "toimg": arrays.toimg, "multicfl": arrays.write_many, "stl": arrays.read_stl, "version": lambda: VERSION,
    "filter_geometric_median": window.geometric_median, "gradient": window.gradient, "detrend": window.detrend, "bin_quadrature": window.quadrature_bins, "bin_amplitude": window.amplitude_bins, "morphop_ball": window.morph_ball, "label": window.label,
    "ssim": reduce.ssim, "mutual_information": reduce.mutual_information, "centre_of_mass": reduce.centre_of_mass, "confusion": reduce.confusion, "dice": reduce.dice, "accuracy": reduce.accuracy, "cross_entropy": reduce.cross_entropy, "norms": reduce.norms, "percentile": reduce.percentile,
}
OPERATORS |= {f"signal_{k}": f for k, f in signals.MODELS.items()} | {"mobasig": lambda spark, model, *a, **k: signals.MODELS[model](spark, *a, **k)}
#: Linear, nonlinear and proximal operators and algorithms, by name.
LINOPS, NLOPS, PROX, ALGORITHMS = linops.CATALOGUE, nlops.CATALOGUE, prox.CATALOGUE, algorithms.ALGORITHMS


def register(name: str, f) -> None:
    """A further operator; a name that is taken is an error."""
    if name in OPERATORS:
        raise ValueError(f"there is an operator {name}")
    OPERATORS[name] = f


def run(name: str, *args, **kwargs):
    if name not in OPERATORS:
        raise ValueError(f"unknown operator {name}")
    return OPERATORS[name](*args, **kwargs)
