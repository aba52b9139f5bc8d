"""Lists, codes, patterns and weights that results depend on.

Everything here is a published constant of the data set or of the
recommendation rules. Changing one changes results.
"""

# --- fixed values: genres, in bit order of the genre mask ---------------------
GENRES = [
    "Action", "Adventure", "Animation", "Children's", "Comedy", "Crime",
    "Documentary", "Drama", "Fantasy", "Film-Noir", "Horror", "Musical",
    "Mystery", "Romance", "Sci-Fi", "Thriller", "War", "Western",
]
ALL_GENRES_MASK = (1 << len(GENRES)) - 1

# --- fixed values: moods and the genres they stand for ------------------------
MOODS = {
    "feel-good": ["Comedy", "Romance", "Musical", "Animation", "Children's"],
    "edge": ["Thriller", "Action", "Crime"],
    "mind": ["Sci-Fi", "Mystery", "Thriller"],
    "emotional": ["Drama", "Romance", "War"],
    "scare": ["Horror"],
    "adventure": ["Adventure", "Fantasy", "Western"],
}

# --- fixed values: inclusive release-year ranges ------------------------------
ERAS = {
    "any": (0, 3000),
    "classic": (0, 1969),
    "7080": (1970, 1989),
    "90s": (1990, 3000),
}
DEFAULT_ERA = "any"

# --- fixed values: inclusive rating-count ranges (None = no upper end) --------
REACH = {
    "popular": (800, None),
    "balanced": (150, None),
    "gems": (40, 500),
}
DEFAULT_REACH = "balanced"

# --- fixed values: stars a reaction stands for --------------------------------
REACTION_STARS = {"loved": 5, "liked": 4, "nope": 2}

# --- fixed values: model and ranking parameters -------------------------------
RANK = 10
QUANT_SCALE = 1000  # stored vectors are whole thousandths
REG_PARAM = 0.05
MAX_ITER = 20
TUNING_CONFIGS = [(10, 0.1, 10), (20, 0.1, 10), (10, 0.05, 20)]  # rank, reg, iterations
TOP_N = 10
MIN_FILM_RATINGS = 20
MIN_SUPPORT = 1000
POOL_MIN_RATINGS = 400
ANCHOR_TIERS = [300, 100, 30]
ANCHOR_LIST = 20
ANCHOR_ENOUGH = 8
ANCHOR_STARS = 5
ANCHOR_WEIGHT = 0.35
ANCHOR_HALF_LIFE = 5
GENRE_BONUS = 1.0
BAYES_WEIGHT = 50

# --- fixed values: display limits of the poster lists -------------------------
POSTER_WALL = 96
POSTER_RING = 20

# --- fixed values: title patterns and the two article lists -------------------
YEAR_SUFFIX = r"\((\d{4})\)\s*$"
YEAR_TAIL = r"\s*\(\d{4}\)\s*$"
DISPLAY_YEAR_TAIL = r"^(.*)\s+\((\d{4})\)\s*$"
DISPLAY_ALTERNATES = r"(\s+\([^()]{3,}\))+$"
ALTERNATE = r"\(([^()]+)\)"
ALTERNATE_WITH_GAP = r"\s*\([^()]+\)"
ALSO_KNOWN_AS = r"(?i)^a\.k\.a\.\s*"
DISPLAY_ARTICLES = ["The", "A", "An", "La", "Le", "Les", "Il", "Das", "Der", "Die", "El"]
SEARCH_ARTICLES = [
    "The", "A", "An", "La", "Le", "Les", "L'", "Il", "Das", "Der", "Die", "El", "Los", "Las",
]
USER_ID_PATTERN = r"^\d{1,7}$"

# --- fixed values: image sizes in poster addresses ----------------------------
FOUND_SIZE = "/w500/"
SAVED_SIZE = "/w342/"

# --- fixed values: demographic code lists -------------------------------------
AGE_LABELS = {
    1: "Under 18", 18: "18-24", 25: "25-34", 35: "35-44",
    45: "45-49", 50: "50-55", 56: "56+",
}
OCCUPATIONS = [
    "other", "academic/educator", "artist", "clerical/admin",
    "college/grad student", "customer service", "doctor/health care",
    "executive/managerial", "farmer", "homemaker", "K-12 student", "lawyer",
    "programmer", "retired", "sales/marketing", "scientist", "self-employed",
    "technician/engineer", "tradesman/craftsman", "unemployed", "writer",
]
