"""All thresholds in one place. Values are the published panel rules."""

from __future__ import annotations

from dataclasses import dataclass

# Thresholds that must equal the reference's for equal results.

# measurement
WILSON_Z = 1.96
READ_MIN, READ_MAX = 200, 6000
SAMPLE_READS = 300
SAMPLE_MAX_MM = 1
GLOBAL_MAX_MM = 5
MIN_COMPETITOR_READS = 150
COVERAGE_SHARE = 0.20
FOLD_THRESHOLD = 8.0
FOLD_CONDITIONAL = 4.0

# qPCR geometry
OLIGO_LENGTH = (18, 25)
GRID_GC = [(40, 60), (37, 63), (35, 65)]
GRID_TM = [(58, 62), (57, 63), (56, 64)]
GRID_PRODUCT = [(60, 150), (60, 200), (60, 250), (60, 400)]
GRID_END_GC = [True, False]
GRID_LAST5 = [True, False]
PRODUCT_IDEAL = (60, 150)
PRODUCT_NOT_ADVISED = 250
PRODUCT_MAX = 400
TA_TARGET = 60.0
TA_RULE = 3.0
HAIRPIN_TM_MAX = 45.0
HOMODIMER_TM_MAX = 45.0
HETERODIMER_TM_MAX = 45.0
STRUCTURE_DG_MIN = -9.0
END_DG_MIN = -5.0
PAIR_DTM_MAX = 1.5
REPRESENTATIVE_BP = 105

# binning
AMPLICON_BP = {"A1": 1500, "B": 1500, "A2": 4300, "F1": 3700, "F2": 3700}
FRAGMENT_MIN = 300
FULL_LOW, FULL_HIGH = 0.80, 1.25
ASSIGN_IDENTITY = 0.97
ASSIGN_IDENTITY_2 = 0.95
ASSIGN_MARGIN = 0.02
ASSIGN_COVERAGE = 0.85
SEGMENT_COVERAGE = 0.80
SATELLITE_SHARE = 0.50
SATELLITE_SAMPLE = 60
CONCATEMER_FACTOR = 1.6


@dataclass(frozen=True)
class Reaction:
    """Salt and oligo concentrations of the melting-temperature model."""

    monovalent_mm: float = 50.0
    divalent_mm: float = 1.5
    dntp_mm: float = 0.6
    oligo_nm: float = 50.0


@dataclass(frozen=True)
class ProductWindow:
    """Accepted product length; stated by the caller because it differs by use."""

    lo: int = 40
    hi: int = 600
