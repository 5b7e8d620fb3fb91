"""Fixed values that results depend on."""

# fixed values: label order used by every operator
LABELS = [
    "toxic",
    "severe_toxic",
    "obscene",
    "threat",
    "insult",
    "identity_hate",
    "racism",
]

# fixed values: default negation words, looked up in the tokens left of a match
NEGATORS = [
    "not", "no", "never", "aint", "ain't", "isnt", "isn't", "arent", "aren't",
    "dont", "don't", "didnt", "didn't", "cant", "can't", "cannot", "won't", "wont",
    "without", "hardly", "barely", "scarcely",
]

# fixed values: severity formula and decision cut-offs
NEGATION_WINDOW = 3
FLAG_THRESHOLD = 0.5
SCORE_CAP = 1.0
COUNT_WEIGHT = 0.50
INTENSITY_WEIGHT = 0.15
DEFAULT_LABEL_THRESHOLD = 0.5

# fixed values: columns the training frame always has
COMMENT_COLUMNS = [
    "source_subreddit", "post_id", "comment_id", "created_utc", "score",
    "body", "permalink", "post_rank", "post_title", "subreddit",
]

# fixed values: bodies that carry no text
EMPTY_BODIES = ["", "[deleted]", "[removed]"]

# fixed values: vocabulary entries per exported shard
VOCABULARY_SHARD = 50000
