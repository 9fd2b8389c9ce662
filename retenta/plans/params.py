"""Parameters of the registered queries (shared by the Spark and SQL sides).

They are the arguments a dashboard user would pass; each query still reads its
whole tables.
"""

SEARCH_Q = "1.1"                 # regex on the client id
SEARCH_LIMIT = 20
HIGH_RISK_PAGE = {"page": 2, "page_size": 15}
HIGH_RISK_PAGE_STATE = {"page": 1, "page_size": 10, "estado": "nation_7", "score_min": 65.0, "score_max": 90.0}
DEEP_PAGE = {"page": 9, "page_size": 15}
PAST_END_PAGE = {"page": 100_000, "page_size": 100, "estado": "nation_7"}
PAGE_RANGES = 16                 # ranges of the page index in the registered queries
HIGH_RISK_AFTER = {"last_score": 75.0, "last_id": 700, "page_size": 15}
TX_PAGE_FIRST = {"page": 1, "page_size": 20}
TX_PAGE_SECOND = {"page": 2, "page_size": 2}
HIGH_RISK_TOP_K = 20
GLOBAL_KPI_MONTH = "1998-03"
GLOBAL_KPI_FIRST_MONTH = "1995-01"   # no previous month: exercises the zero branch
# Fixed values of the fixture domain: part types (chatbot inputs) and order
# priorities (operation types), the pivot columns.
INPUT_VALUES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
OPERATION_VALUES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
# Fixed values of the fixture domain: event types (conversation inputs).
CONVERSATION_INPUT_VALUES = ["click", "error", "purchase", "signup", "view"]
TOP_PER_MONTH = 3
TOP_PRODUCTS = 8
SAMPLE_ROWS = 800
SAMPLE_SEED = 42
HIGH_RISK_SEARCH_TERM = "nation_1"   # substring of the id or the state
HIGH_RISK_SEARCH_ROWS = 5
INDEXED_SEARCH_TERM = "Nation_12"
INDEXED_SEARCH_REGEX = "ATION.1"   # by its literal parts
REPORT_TOP_ROWS = 10
REPORT_TOP_CITIES = 5
MODEL_ITERATIONS = 10
MODEL_AUC_FLOOR = 0.5
CLIENT_ID = 7                        # the client of the one-client queries
CLIENT_TX_PAGE = {"page": 1, "page_size": 20}
