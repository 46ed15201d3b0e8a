"""Small dimension tables of fixed values. All of them are constants with at most 24 rows, so
broadcasting them is always safe."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from echoloom.session import inline_table

# Mixture buckets. bucket, content, recipe, share, loss weight.
BUCKETS = [
    ("P0_word_direct", "word", "M0", 0.10, 1.00),
    ("P1_word_one_noise", "word", "M1", 0.40, 1.15),
    ("P2_word_two_noise", "word", "M2", 0.28, 1.25),
    ("P3_word_two_noise_hard", "word", "M3", 0.22, 1.30),
    ("N0_filler_direct", "filler", "M0", 0.05, 0.80),
    ("N1_filler_one_noise", "filler", "M1", 0.05, 0.90),
    ("N2_filler_two_noise", "filler", "M2", 0.04, 1.00),
    ("N3_filler_two_noise_hard", "filler", "M3", 0.03, 1.10),
    ("N4_real_direct", "real", "M0", 0.05, 0.90),
    ("N5_real_one_noise", "real", "M1", 0.06, 1.00),
    ("N6_real_two_noise", "real", "M2", 0.04, 1.10),
    ("N7_real_two_noise_hard", "real", "M3", 0.03, 1.20),
    ("N8_babble_direct", "babble", "M0", 0.04, 1.00),
    ("N9_babble_one_noise", "babble", "M1", 0.06, 1.10),
    ("N10_babble_two_noise", "babble", "M2", 0.05, 1.20),
    ("N11_babble_two_noise_hard", "babble", "M3", 0.06, 1.30),
    ("N12_noise_direct", "noise", "M0", 0.10, 0.90),
    ("N13_noise_one_noise", "noise", "M1", 0.12, 1.00),
    ("N14_noise_two_noise", "noise", "M2", 0.05, 1.00),
    ("N15_noise_two_noise_hard", "noise", "M3", 0.03, 1.10),
    ("N16_confus_direct", "confus", "M0", 0.03, 1.00),
    ("N17_confus_one_noise", "confus", "M1", 0.05, 1.10),
    ("N18_confus_two_noise", "confus", "M2", 0.04, 1.10),
    ("N19_confus_two_noise_hard", "confus", "M3", 0.02, 1.20),
]

# Recipes. recipe, layers, SNR range per layer (dB), aggressiveness range.
RECIPES = [
    ("M0", 0, [], (0.00, 0.20)),
    ("M1", 1, [(12.0, 26.0)], (0.05, 0.35)),
    ("M2", 2, [(8.0, 22.0), (0.0, 16.0)], (0.20, 0.60)),
    ("M3", 2, [(2.0, 14.0), (-4.0, 10.0)], (0.55, 1.00)),
]

# Kinds of the older negative mixture and their shares.
NEGATIVE_KINDS = {"speech": 0.22, "babble": 0.16, "noise": 0.24, "speech_in_noise": 0.24, "confusable": 0.14}

# Chances of the effects (pairs are base and slope over the aggressiveness).
PROFILES = {"v4": {"telephonic": 0.06, "bitcrush": (0.02, 0.05), "dropout": (0.08, 0.18), "mems": 0.0}}

# Talker distance in metres -> sound pressure in dB; vocal effort and level ranges.
DISTANCE_SPL = {0.3: 70.0, 0.5: 66.0, 1.0: 60.0, 2.0: 54.0, 3.0: 50.5}
REFERENCE_SPL = 60.0
MIC_SNR = 61.0
EFFORT_DB = (-15.0, 12.0)
LEVEL_DBFS = (-50.0, -14.0)

# Grids of the evaluation jobs.
FPR_BUDGETS = [0.0005, 0.001, 0.002, 0.005, 0.01, 0.02, 0.05]
COARSE_GRID = [0.50, 0.65, 0.75, 0.80, 0.85, 0.90, 0.95]
SWEEP_THRESHOLDS = [0.60, 0.70, 0.78, 0.84, 0.90]
POLICIES = ["1/2", "2/2", "2/3", "3/4"]
OFFSETS = list(range(0, 25, 2))
GAINS_DB = [-24, -18, -12, -6, 0, 6, 12, 18]


def bucket_dim(spark: SparkSession) -> DataFrame:
    return inline_table(spark, "bucket, content, recipe, share, loss_weight", BUCKETS)


def recipe_dim(spark: SparkSession) -> DataFrame:
    """recipe, layers, snr array<struct<lo,hi>>, aggr_lo, aggr_hi"""
    rows = [(r, n, list(snr), a[0], a[1]) for r, n, snr, a in RECIPES]
    return inline_table(spark, "recipe, layers, snr, aggr_lo, aggr_hi", rows)


def shares(positive: bool) -> dict[str, float]:
    mark = "P" if positive else "N"
    return {b: s for b, _, _, s, _ in BUCKETS if b.startswith(mark)}
