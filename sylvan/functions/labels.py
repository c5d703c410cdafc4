"""Genus to broad class, and class names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The genera of each class.
CONIFERS = ("Picea", "Pinus")
BROADLEAVES = ("Acer", "Tilia", "Ulmus", "Zelkova", "Gleditsia", "Carya", "Juglans", "Carpinus", "Celtis", "Cercis", "Cladrastis", "Gymnocladus", "Liriodendron", "Prunus", "Quercus", "Ginkgo", "Pyrus")
ALL_CONIFERS = (
    "Abies", "Calocedrus", "Chamaecyparis", "Cryptomeria", "Cupressocyparis", "Ginkgo", "Juniperus", "Larix", "Metasequoia", "Picea", "Pinus",
    "Platycladus", "Pseudotsuga", "Taxodium", "Taxus", "Thuja", "Tsuga", "Cedrus", "Cupressus", "Glyptostrobus", "Sequoia", "Sequoiadendron",
)
ORNAMENTALS = (
    "Aesculus", "Amelanchier", "Catalpa", "Cercidiphyllum", "Cercis", "Chionanthus", "Cladrastis", "Cornus", "Cotinus", "Crataegus", "Cydonia",
    "Eucommia", "Ficus", "Gymnocladus", "Halesia", "Ilex", "Koelreuteria", "Laburnum", "Liriodendron", "Maclura", "Maackia", "Magnolia", "Malus",
    "Parrotia", "Paulownia", "Phellodendron", "Platanus", "Prunus", "Pyrus", "Sassafras", "Sorbus", "Sophora", "Syringa", "Xanthoceras", "Zelkova",
)
CLASSES = ("conifer", "broadleaf")


def two_class(genus: Column) -> Column:
    """conifer or broadleaf; NULL for any other genus."""
    g = F.trim(genus)
    return F.when(g.isin(*CONIFERS), "conifer").when(g.isin(*BROADLEAVES), "broadleaf")


def two_class_index(genus: Column) -> Column:
    g = F.trim(genus)
    return F.when(g.isin(*CONIFERS), 0).when(g.isin(*BROADLEAVES), 1)


def three_class(genus: Column) -> Column:
    """Any other genus, and NULL, is deciduous."""
    g = F.trim(genus)
    return F.when(g.isin(*ALL_CONIFERS), "conifer").when(g.isin(*ORNAMENTALS), "urban_ornamental").otherwise("deciduous")


def catch_all_two_class(genus: Column) -> Column:
    return F.when(F.trim(genus).isin(*ALL_CONIFERS), "conifer").otherwise("broadleaf")


def class_name(index: Column) -> Column:
    """0 conifer, 1 broadleaf, else NULL."""
    return F.create_map(F.lit(0), F.lit("conifer"), F.lit(1), F.lit("broadleaf"))[index]


def argmax2(p0: Column, p1: Column) -> Column:
    """0 or 1; a tie goes to 0."""
    return F.when(p0 >= p1, 0).otherwise(1)
