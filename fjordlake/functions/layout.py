"""Column expressions for views: layout classes, zoom and sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def layout(width: Column, height: Column) -> Column:
    large = (F.greatest(width, height) >= 720) & (F.least(width, height) >= 500)
    return (
        F.when(width >= 1200, "desktop")
        .when(large, "tabletLandscape")
        .when((width > height) & (height <= 500), "mobileLandscape")
        .when((height > width) & (width <= 600), "mobilePortrait")
        .otherwise("tablet")
    )


def has_sidebar(kind: Column) -> Column:
    return kind.isin("desktop", "tabletLandscape")


def has_menu(kind: Column) -> Column:
    return kind.isin("tablet", "mobilePortrait", "mobileLandscape")


def has_mobile_slider(kind: Column) -> Column:
    return kind.isin("mobilePortrait", "mobileLandscape")


def screen_size(width: Column) -> Column:
    return F.when(width <= 375, "small").when(width <= 414, "medium").otherwise("large")


def initial_zoom(width: Column, height: Column) -> Column:
    """Zoom from 6.0 to 6.8 at which a view shows the whole area."""
    wide = F.lit(6.5) - F.log2(height / 600)
    narrow = F.lit(6.2) - F.log2(width / 400)
    zoom = F.when(width / height > 1.4, wide).otherwise(narrow)
    return F.least(F.greatest(zoom, F.lit(6.0)), F.lit(6.8))


def arrow_size(is_mobile: Column, zoom: Column) -> Column:
    mobile = F.when(zoom < 6, 0.010).when(zoom < 7, 0.013).otherwise(0.016)
    return F.when(is_mobile, mobile).otherwise(0.025)
