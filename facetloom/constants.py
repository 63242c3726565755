"""Values that results depend on, and the default arguments of the operators."""

# Coarse sentiment of an emotion label. Every label in neither
# list (approval and desire among them) counts as neutral.
POSITIVE_EMOTIONS = (
    "admiration", "amusement", "gratitude", "joy", "love",
    "optimism", "pride", "relief", "caring", "excitement",
)
NEGATIVE_EMOTIONS = (
    "anger", "annoyance", "disappointment", "disapproval", "disgust", "embarrassment",
    "fear", "grief", "nervousness", "remorse", "sadness", "confusion",
)

# The 28 labels of the public GoEmotions taxonomy.
EMOTION_LABELS = (
    "admiration", "amusement", "anger", "annoyance", "approval", "caring", "confusion",
    "curiosity", "desire", "disappointment", "disapproval", "disgust", "embarrassment",
    "excitement", "fear", "gratitude", "grief", "joy", "love", "nervousness", "optimism",
    "pride", "realization", "relief", "remorse", "sadness", "surprise", "neutral",
)

# Class names of the three-way sentiment model.
SENTIMENT_CLASSES = {"LABEL_0": "negative", "LABEL_1": "neutral", "LABEL_2": "positive"}

# Birth years of the cohort, both ends included.
COHORT_START, COHORT_END = 1997, 2012

# Thresholds and sizes.
GATE_MIN_CONFIDENCE = 0.90
ATTRIBUTE_MIN_CONFIDENCE = 0.85
SIMILARITY_MIN = 0.40
VALIDATION_EVERY = 20
MAP_CLUSTERS = 8
MAP_DIMENSIONS = 50
DENSITY_MIN_SIZE = 30
VOCABULARY_SIZE = 5000
SVD_DIMENSIONS = 50
EMBED_CHARS = 1000
PREVIEW_CHARS = 60
SCORING_BATCH = 32
EMBEDDING_BATCH = 64
DEFAULT_PERSONA = 3
EMOTION_SLOTS = 5
ATTRIBUTE_SLOTS = 4

# Columns of the persona map.
MAP_NUMERIC = ("age", "birth_year_est", "emotion_conf", "reddit_conf", "is_genz", "masking")
MAP_CATEGORICAL = (
    "job", "horoscope", "top_emotion", "emotion_sentiment", "reddit_sentiment",
    "emo1_label", "emo2_label", "emo3_label", "emo4_label", "emo5_label",
)
CLUSTERED_COLUMNS = (
    "text", "top_emotion", "reddit_sentiment",
    "emo1_label", "emo1_conf", "emo2_label", "emo2_conf",
    "emo3_label", "emo3_conf", "emo4_label", "emo4_conf",
    "horoscope", "job", "masking", "cluster", "x2d", "y2d", "cluster_color_name",
)
PROFILE_CATEGORICAL = (
    "top_emotion", "emotion_sentiment", "reddit_sentiment", "horoscope", "job",
    "emo1_label", "emo2_label", "emo3_label", "emo4_label", "emo5_label", "color_name",
)
PERSONA_CATEGORICAL = ("top_emotion", "horoscope", "job")

# Texts of the reaction prompt.
PROMPT_SYSTEM = (
    "You write a very short reaction (1–2 sentences). "
    "Match the persona traits provided. Avoid emojis and hashtags."
)
PROMPT_REQUEST = (
    "Using the persona traits (and, if provided, the nearest-sample attributes), "
    "write a brief reaction in that persona's style."
)
PROMPT_SIMILARITY = "Nearest-sample similarity: "
PROMPT_ATTRIBUTES = "Nearest-sample attributes (no text): "
PROMPT_EMOTIONS = "Nearest-sample high-confidence emotions: "
PROMPT_MESSAGE = "\n\nMessage: "

# Headings of a persona's description.
TRAITS_PERSONA = "Persona #"
TRAITS_TITLE = " traits:"
TRAITS_EMOTIONS = "\n- Typical emotions: "
TRAITS_WORDS = "\n- Common words/phrases: "
TRAITS_TONE = "\n- Overall tone tendency: "
TRAITS_MISSING = " (no card found)"
