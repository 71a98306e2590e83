"""Shipped calibration values as small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values of the shipped calibration.
DELTA_E_REF = 14.36466145271401
LEVELS = ("low", "medium", "high", "very_high")
THRESHOLDS = {
    "C_lab": (36.652529522668175, 42.09814018094347, 49.80702109771229, 60.25492929058377),
    "H_lab_deg": (25.969939593118962, 29.93192790366794, 33.10545836895408, 36.8057203570953),
    "L_lab": (39.65042107968112, 44.54522732424454, 49.844050827617416, 55.77329043797519),
    "Y_rel": (0.11041584440107591, 0.1421889262919707, 0.1828839813877369, 0.23687247898628971),
    "a_lab": (32.18076523200856, 37.41130493300516, 43.832105823054825, 52.752705447336155),
    "b_lab": (15.905921667870095, 19.329553907607345, 23.996701987935747, 29.921919213650956),
    "colorfulness": (0.10589574817140084, 0.1207645769461504, 0.1420537653551541, 0.1725846665495741),
    "depth": (50.15594917238259, 55.45477267575546, 60.349578920318876, 65.61591145285703),
    "light_hsl": (0.4117647058823529, 0.4607843137254902, 0.5176470588235295, 0.5862745098039215),
    "sat_eff": (0.806196095810145, 1.015895082385789, 1.258929515844097, 1.5343983131568297),
    "sat_hsl": (0.4330708661417323, 0.5056179775280897, 0.5867301587301588, 0.7037701378508553),
    "warmth": (-1.1525096790061784, 2.2253052134572187, 4.943332759267763, 8.341953984440789),
}
SCALE_IQR = {
    "C_lab": 22.476674473369727,
    "H_lab_deg": 12.47602906032867,
    "L_lab": 17.235846400430958,
    "Y_rel": 0.1239799629585284,
    "a_lab": 20.62944803906401,
    "b_lab": 14.441803189641789,
    "colorfulness": 0.06339079831761636,
    "depth": 17.235846400430965,
    "light_hsl": 0.18627450980392157,
    "sat_eff": 0.741864103122226,
    "sat_hsl": 0.2674117100932861,
    "warmth": 10.885363571054224,
}
SCALE_STD = {
    "C_lab": 16.474458008676482,
    "H_lab_deg": 56.28398896729196,
    "L_lab": 13.00089044480179,
    "Y_rel": 0.11228249969742377,
    "a_lab": 14.462569822151544,
    "b_lab": 12.057196670464894,
    "colorfulness": 0.049264530526229505,
    "depth": 13.00089044480179,
    "light_hsl": 0.13508119811986294,
    "sat_eff": 0.472367324373688,
    "sat_hsl": 0.1975731940437804,
    "warmth": 9.911524440756565,
}
#: Dimensions whose levels are quantiles of the pool, with their smallest pool and quantiles.
RELATIVE = {
    "light_hsl": (120, (0.6, 0.75, 0.88, 0.94)),
    "sat_hsl": (120, (0.6, 0.75, 0.88, 0.94)),
    "depth": (120, (0.6, 0.75, 0.92, 0.98)),
    "colorfulness": (120, (0.6, 0.75, 0.92, 0.98)),
    "warmth": (120, (0.6, 0.75, 0.88, 0.94)),
}
DEFAULT_QUANTILES = (0.70, 0.80, 0.90, 0.95)
PREFERENCE_WEIGHTS = {"L": -0.09514461466212361, "C": -0.08219616192871376, "H": 0.030102111869975023}
QUANTILES = (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95)
#: Quantiles of L, C and h of each label in this order.
LABEL_DISTRIBUTIONS = {
    "brown": {
        "L": (24.230425190401782, 27.66974990816668, 33.185813464373815, 39.31846496172359, 46.04869692073861, 50.995293454044244, 53.361783070954154),
        "C": (28.396741212978007, 30.347790494583094, 34.83687067177553, 41.566818862477554, 52.42224380410359, 61.278664352380275, 65.84100120641703),
        "h": (11.2586326512033, 15.697483987680215, 22.749373097847595, 29.586374694461, 34.61002849680452, 39.47088438962558, 43.48020788300158),
    },
    "coral": {
        "L": (46.01596738403675, 47.092600967181006, 50.54940908883568, 54.750346013783044, 59.94326889440141, 64.00637376268921, 66.69955628877433),
        "C": (41.52893335812277, 45.107440653351546, 52.07702278802784, 60.78279945650861, 69.36110001377553, 73.8641192837706, 75.97644947171501),
        "h": (12.899318001284524, 17.437957608410215, 24.61821298656254, 29.92427812146326, 33.798762707476016, 37.52472048779493, 39.54976286547541),
    },
    "pink": {
        "L": (58.305027528835566, 58.945738588554214, 61.26388765657964, 65.553263122974, 70.2364899975439, 74.35101175116095, 77.8223188780554),
        "C": (23.29851421064256, 25.25912474438683, 29.157802517548436, 32.925487256462226, 37.87694312709343, 43.853891610592804, 48.37548875589174),
        "h": (7.0145482237628025, 10.585957457307837, 16.087097367124784, 22.983950704737197, 31.530507008628206, 48.92833207872045, 347.40700936908587),
    },
    "red": {
        "L": (38.61656765034135, 40.91096897399534, 42.869418262107594, 45.35985313886316, 50.43290343164129, 53.806474412677986, 55.20714636474767),
        "C": (76.16751976309205, 76.87750146325837, 78.66269893252951, 81.01218341696118, 84.30942340576432, 88.77194000182864, 91.47856053922776),
        "h": (28.578179381177396, 29.462375369348273, 31.908962724052245, 34.9826646435487, 37.50413211113799, 39.602941697425514, 40.60522614215833),
    },
    "taupe": {
        "L": (26.19521413144758, 27.327318933034654, 30.269664460009274, 38.093903441291395, 46.8114664613047, 50.05221428704555, 51.892479564122546),
        "C": (15.01182043259845, 16.58326481385235, 17.65167532057578, 19.77847121807535, 21.26323873956794, 22.796027293842858, 23.559341273788903),
        "h": (8.60670015014331, 10.248300936671354, 26.406466934872185, 37.42056198372745, 48.577935445268736, 78.95868736175984, 334.7216395623301),
    },
}


def calibration(spark: SparkSession) -> DataFrame:
    """dim, relative, min_pool_n, quantiles and thresholds by level, scale (IQR, else standard deviation, else 1): one row for each scoring dimension."""
    rows = []
    for dim, thresholds in THRESHOLDS.items():
        min_n, quantiles = RELATIVE.get(dim, (0, DEFAULT_QUANTILES))
        iqr, std = SCALE_IQR[dim], SCALE_STD[dim]
        scale = iqr if iqr > 1e-12 else std if std > 1e-12 else 1.0
        rows.append((dim, dim in RELATIVE, min_n, list(quantiles), list(thresholds), scale))
    return spark.createDataFrame(rows, "dim string, relative boolean, min_pool_n int, quantiles array<double>, thresholds array<double>, scale double")


def label_distributions(spark: SparkSession) -> DataFrame:
    """label, axis, q array: the shipped quantiles in the order of QUANTILES."""
    rows = [(label, axis, list(q)) for label, axes in LABEL_DISTRIBUTIONS.items() for axis, q in axes.items()]
    return spark.createDataFrame(rows, "label string, axis string, q array<double>")
