"""Cosine similarities between the patches of an image: how many edges a threshold leaves, and quantiles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from patchloom.operators.spectral import directions


def cosines(features: DataFrame, tau: float) -> DataFrame:
    """image, edge_fraction, q05, q50, q95 over all pairs of different patches of an image. `features`: image, patch, vec.

    One matrix product an image. An image of a single patch has no pair and no row; one of no patches likewise.
    """
    image = features.schema["image"].dataType.simpleString()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        unit = directions(np.stack(group["vec"].to_list()).astype(float))
        patch = group["patch"].to_numpy()
        cos = (unit @ unit.T)[patch[:, None] != patch]
        row = [(group["image"].iloc[0], np.mean(cos > tau), *np.quantile(cos, [0.05, 0.5, 0.95]))] if cos.size else []
        return pd.DataFrame(row, columns=["image", "edge_fraction", "q05", "q50", "q95"])

    return features.select("image", "patch", "vec").groupBy("image").applyInPandas(run, f"image {image}, edge_fraction DOUBLE, q05 DOUBLE, q50 DOUBLE, q95 DOUBLE")
