"""Names, labels and limits that results must use exactly as they are."""

from __future__ import annotations

# Identification columns, months and statistics of the long table.
ID_COLUMNS = ["Ano", "Mes", "Calc"]
MONTHS = ["Jan", "Fev", "Mar", "Abr", "Mai", "Jun", "Jul", "Ago", "Set", "Out", "Nov", "Dez"]
ANNUAL = "Ano"
STATISTICS = ["Mín.", "Méd.", "Máx."]
WET_MONTHS = [10, 11, 12, 1, 2, 3]

# Texts that mean "not measured".
MISSING_MARKERS = ["--", "---", "-", ""]

# Measurement columns in canonical order.
FEATURES = [
    "COR(ppm Pt Co)",
    "TURB.(FTU)",
    "pH",
    "ALC.(ppm CaCO3)",
    "AC.(ppm CaCO3)",
    "O.C.(ppm O2)",
    "DBO(ppm O2)",
    "O.D.(ppm O2)",
    "Cl-(ppm Cl-)",
    "DUR.(ppm CaCO3)",
    "Fe(ppm Fe)",
    "Mn(mg/l)",
    "N(ppm N)",
    "P(ppm P)",
    "Cond.(uS/cm)",
    "Amonia(mg/l)",
    "Surfact.(mg/l)",
    "Cianobacteria(cel/ml)",
    "S.T.(mg/l)",
    "C.T.(NMP/100ml)",
    "C.F.(NMP/100ml)",
    "CLOROFILA(ug/l)",
    "F(ppm F)",
]

# Themes of the measurement columns.
FEATURE_GROUPS = {
    "fisica": ["COR(ppm Pt Co)", "TURB.(FTU)", "Cond.(uS/cm)", "S.T.(mg/l)"],
    "iao_basico": ["pH", "ALC.(ppm CaCO3)", "AC.(ppm CaCO3)", "DUR.(ppm CaCO3)"],
    "oxigenio": ["O.C.(ppm O2)", "DBO(ppm O2)", "O.D.(ppm O2)"],
    "nutrientes": ["N(ppm N)", "P(ppm P)", "Amonia(mg/l)"],
    "metais": ["Fe(ppm Fe)", "Mn(mg/l)"],
    "anions": ["Cl-(ppm Cl-)", "F(ppm F)"],
    "biologico": ["Cianobacteria(cel/ml)", "C.T.(NMP/100ml)", "C.F.(NMP/100ml)", "CLOROFILA(ug/l)"],
    "outros": ["Surfact.(mg/l)"],
}

# Legal limits for class-2 fresh water (variable, low, high, indicative).
CLASS2_LIMITS = [
    ("COR(ppm Pt Co)", None, 75.0, False),
    ("TURB.(FTU)", None, 100.0, False),
    ("pH", 6.0, 9.0, False),
    ("DBO(ppm O2)", None, 5.0, False),
    ("O.D.(ppm O2)", 5.0, None, False),
    ("Cl-(ppm Cl-)", None, 250.0, False),
    ("Fe(ppm Fe)", None, 0.3, True),
    ("Mn(mg/l)", None, 0.1, False),
    ("P(ppm P)", None, 0.1, False),
    ("Amonia(mg/l)", None, 3.7, False),
    ("Surfact.(mg/l)", None, 0.5, False),
    ("Cianobacteria(cel/ml)", None, 50000.0, False),
    ("C.F.(NMP/100ml)", None, 1000.0, False),
    ("CLOROFILA(ug/l)", None, 30.0, False),
    ("F(ppm F)", None, 1.4, False),
]

# Header spellings (lower case, letters and digits only) and their column.
HEADER_SYNONYMS = {
    "corppmptco": "COR(ppm Pt Co)",
    "turbftu": "TURB.(FTU)",
    "ph": "pH",
    "alcppmcaco3": "ALC.(ppm CaCO3)",
    "acppmcaco3": "AC.(ppm CaCO3)",
    "ocppmo2": "O.C.(ppm O2)",
    "dboppmo2": "DBO(ppm O2)",
    "odppmo2": "O.D.(ppm O2)",
    "clppmcl": "Cl-(ppm Cl-)",
    "durppmcaco3": "DUR.(ppm CaCO3)",
    "feppmfe": "Fe(ppm Fe)",
    "mnmgl": "Mn(mg/l)",
    "nppmn": "N(ppm N)",
    "pppmp": "P(ppm P)",
    "condscm": "Cond.(uS/cm)",
    "conduscm": "Cond.(uS/cm)",
    "amnia": "Amonia(mg/l)",
    "amonia": "Amonia(mg/l)",
    "surfactmgl": "Surfact.(mg/l)",
    "cianobacteriancelml": "Cianobacteria(cel/ml)",
    "cianobactriasnclml": "Cianobacteria(cel/ml)",
    "stmgl": "S.T.(mg/l)",
    "ctnmp100ml": "C.T.(NMP/100ml)",
    "cfnmp100ml": "C.F.(NMP/100ml)",
    "ecolinmp100ml": "C.F.(NMP/100ml)",
    "clorofilamgl": "CLOROFILA(ug/l)",
    "clorofilaugl": "CLOROFILA(ug/l)",
    "fppmn": "F(ppm F)",
    "fppmf": "F(ppm F)",
}

# Statistic labels left after every character but a-z and the dot is removed.
STATISTIC_SPELLINGS = {
    "min.": "Mín.",
    "mn.": "Mín.",
    "med.": "Méd.",
    "md.": "Méd.",
    "max.": "Máx.",
    "mx.": "Máx.",
}

# Thresholds and parameters.
SEED = 42
DROP_ABOVE = 0.30
SIMPLE_BELOW = 0.05
SCALE_ABOVE = 0.15
SKEW_ABOVE = 1.0
IMPUTE_NEIGHBORS = 5
CONTAMINATION = 0.07
CONTAMINATION_GRID = [0.05, 0.06, 0.07, 0.08, 0.09, 0.10]
IQR_FACTOR = 1.5
MAD_ABOVE = 3.5
MAD_FACTOR = 0.6745
LOF_NEIGHBORS = 20
MIN_OBSERVATIONS = 30
MULTI_MAX_MISSING = 0.05
FOREST_TREES = 200
FOREST_SAMPLE = 256
SILHOUETTE_GOOD = 0.5
CLASSIFIER_TREES = 100
CLASSIFIER_DEPTH = 10
TEST_SHARE = 0.20
CV_FOLDS = 5
MIN_METHODS = 4
EVENT_YEARS = (2014, 2016)
