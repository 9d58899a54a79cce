"""Camera lenses: matrices are computed once on the driver and become literals of column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Lens:
    """What a camera sees through; subclasses map between pixels and the world."""

    resolution: tuple[int, int] = (0, 0)
    origin: tuple[float, ...] = (0.0, 0.0, 0.0)

    def pixel_to_world(self, x, y, depth) -> tuple[Column, Column, Column]:
        raise NotImplementedError

    def world_to_pixel(self, x, y, z) -> tuple[Column, Column]:
        raise NotImplementedError


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


@dataclass(frozen=True)
class IdentityLens(Lens):
    """Pixels are world coordinates."""

    def pixel_to_world(self, x, y, depth):
        return _c(x), _c(y), _c(depth)

    def world_to_pixel(self, x, y, z):
        return _c(x), _c(y)


@dataclass(frozen=True)
class PinholeLens(Lens):
    """fov in degrees; the origin's x and y are the principal point, skew the off-diagonal of the intrinsics."""

    fov: float = 90.0
    skew: float = 0.0

    @property
    def focal(self) -> tuple[float, float]:
        half = math.tan(math.radians(self.fov / 2))
        return self.resolution[0] / 2 / half, self.resolution[1] / 2 / half

    def intrinsics(self) -> np.ndarray:
        fx, fy = self.focal
        return np.array([[fx, self.skew, self.origin[0]], [0, fy, self.origin[1]], [0, 0, 1.0]])

    def pixel_to_world(self, x, y, depth=1.0):
        fx, fy = self.focal
        ox, oy = self.origin[:2]
        x, y, depth = _c(x), _c(y), _c(depth)
        wy = (y - oy * depth) / fy
        return (x - self.skew * wy - ox * depth) / fx, wy, depth

    def world_to_pixel(self, x, y, z=1.0, perspective: bool = False):
        fx, fy = self.focal
        return project(_c(x), _c(y), _c(z), F.lit(fx), F.lit(fy), F.lit(float(self.origin[0])), F.lit(float(self.origin[1])), F.lit(float(self.skew)), perspective)


def project(x: Column, y: Column, z: Column, fx: Column, fy: Column, ox: Column, oy: Column, skew: Column, perspective: bool = False) -> tuple[Column, Column]:
    """Pinhole projection by columns, such as those of a joined camera row; homogeneous unless perspective is asked for."""
    u, v = fx * x + skew * y + ox * z, fy * y + oy * z
    return (u / z, v / z) if perspective else (u, v)


@dataclass(frozen=True)
class VRLens(Lens):
    """A lens turned by yaw, pitch and roll (radians) about its origin. Its transform takes pixels to the world, the inverse takes the world to pixels."""

    yaw: float = 0.0
    pitch: float = 0.0
    roll: float = 0.0

    def matrix(self) -> np.ndarray:
        """Pixel to world, 4 x 4: the left-handed rotation, which is the transpose of the right-handed one, and minus the rotated origin."""
        sa, ca, sb, cb, sc, cc = (f(x) for x in (self.yaw, self.pitch, self.roll) for f in (math.sin, math.cos))
        turn_z, turn_y, turn_x = np.array([[ca, -sa, 0], [sa, ca, 0], [0, 0, 1]]), np.array([[cb, 0, sb], [0, 1, 0], [-sb, 0, cb]]), np.array([[1, 0, 0], [0, cc, -sc], [0, sc, cc]])
        out = np.eye(4)
        out[:3, :3] = (turn_z @ turn_y @ turn_x).T
        out[:3, 3] = -out[:3, :3] @ np.array(self.origin[:3], float)
        return out

    @staticmethod
    def _times(m: np.ndarray, x, y, z, w: float) -> tuple[Column, ...]:
        parts = [_c(x), _c(y), _c(z)]
        return tuple(sum((F.lit(float(m[i, j])) * parts[j] for j in range(3)), F.lit(float(m[i, 3] * w))) for i in range(3))

    def pixel_to_world(self, x, y, depth=1.0, w: float = 1.0):
        return self._times(self.matrix(), x, y, depth, w)

    def world_to_pixel(self, x, y, z=1.0, w: float = 1.0):
        return self._times(np.linalg.inv(self.matrix()), x, y, z, w)[:2]
