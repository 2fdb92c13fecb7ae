"""Energies and Compton kinematics as column expressions. Energies are in MeV."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Electron rest energy (MeV), width of a Gaussian at half its height over sigma, density of NaI (g/cm^3).
ELECTRON = 0.511
FWHM = 2.355
NAI_DENSITY = 3.67


def lit(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def resolution_at(e0: float, at_662: float) -> float:
    """Relative energy resolution at e0 from that at 662 keV."""
    return at_662 * (0.662 / e0) ** 0.5


def first_deposit_limit(e0: float) -> float:
    """The largest first deposit that a single scatter allows, a keV less."""
    return 2 * e0 * e0 / (ELECTRON + 2 * e0) - 0.001


def window(e1: Column, e2: Column, most: float, least: float = 0.05, total: float = 0.46, closed: bool = False) -> Column:
    """The energy window; ``closed`` lets a sum equal to ``total`` pass."""
    both = e1 + e2
    return (e1 < most) & (e1 > least) & (e2 > least) & ((both >= total) if closed else (both > total))


def smear(e: Column, e0: float, resolution: float, normal: Column) -> Column:
    """An energy with detector noise; sigma is resolution / 2.355 * sqrt(e * e0)."""
    safe = F.greatest(e, F.lit(1e-12))
    return e + safe * (resolution / FWHM) * F.sqrt(F.lit(e0) / safe) * normal


def scatter_cosine(e1: Column, e0: float) -> Column:
    """Cosine of the scatter angle after a first deposit e1; null where the division has no value."""
    rest = F.lit(e0) - e1
    return F.when(rest != 0, 1 - e1 * ELECTRON / (rest * e0))


def is_kinematic(e1: Column, e0: float, margin: float = 1e-6) -> Column:
    c = scatter_cosine(e1, e0)
    return F.coalesce((c > -1 + margin) & (c < 1 - margin), F.lit(False))


def scatter_angle(e1: Column, e0: float, eps: float = 1e-7) -> Column:
    """The scatter angle, its cosine clamped."""
    return F.acos(F.greatest(F.least(scatter_cosine(e1, e0), F.lit(1 - eps)), F.lit(-1 + eps)))


def scatter_angle_or_null(e1: Column, e0: float) -> Column:
    """The scatter angle of a possible deposit, else null."""
    ok = (e1 > 0) & (e1 < e0)
    c = F.when(ok, scatter_cosine(e1, e0))
    return F.when((c > -1) & (c < 1), F.acos(F.greatest(F.least(c, F.lit(1 - 1e-9)), F.lit(-1 + 1e-9))))


def klein_nishina(e1: Column, e0: float) -> Column:
    """Klein-Nishina weight of a first deposit; 0 where it isn't possible."""
    theta = scatter_angle_or_null(e1, e0)
    rest = F.when(theta.isNotNull(), F.lit(e0) - e1)
    s = F.sin(theta)
    return F.coalesce(F.lit(e0) / rest + rest / e0 - s * s, F.lit(0.0))


def scattered_energy(cosine: Column, e0: float) -> Column:
    return F.lit(e0) / (1 + (e0 / ELECTRON) * (1 - cosine))


def klein_nishina_pdf(mu: Column, alpha: float) -> Column:
    """Relative density of mu = cos(theta); alpha is the incident energy over the electron's."""
    k = 1 / (1 + alpha * (1 - mu))
    return k * k * (k + 1 / k - (1 - mu * mu))


def free_path(u: Column, mu: Column) -> Column:
    """Free path in cm for a uniform u and an attenuation mu (1/cm)."""
    return -F.log(F.greatest(u, F.lit(1e-15))) / mu


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(60.0)), F.lit(-60.0))))
