"""Fixed values that results depend on."""

# The keywords that are counted, matched exactly and in lower case.
WATCHED = [
    "travelban",
    "daca",
    "thewall",
    "guncontrol",
    "shooting",
    "gunsense",
    "nra",
    "healthcare",
    "obamacare",
    "medicare",
    "medicaid",
]

# The number each sentiment stands for in a mean.
SENTIMENT_VALUES = {"negative": -1.0, "neutral": 0.0, "positive": 1.0}

# Jobs kept by retention and the result delimiter.
RETAINED_JOBS = 100
DELIMITER = "\t"
