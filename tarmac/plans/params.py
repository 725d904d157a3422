"""Parameters of the catalog queries, shared by the Spark side and the SQL
oracle: the dashboard's default range, its 2019 counterpart, the
chronological split and the columns correlated with the target."""

from ..sources.schema import EARLIER_NUMERICAL_FEATURES
from .prepare import SPLIT_DATE

START, END = "2022-01-01", "2022-01-31"   # the dashboard's default range
REF_START, REF_END = "2019-01-01", "2019-01-31"
SPLIT = SPLIT_DATE
CORRELATION_FEATURES = list(EARLIER_NUMERICAL_FEATURES)
EMPTY_RANGE = ("2015-01-01", "2015-01-31")   # before the first day of the fixture
TWO_FEATURES = ["is_weekend", "avg_pre_pandemic_monthly_traffic"]   # of the closed-form fits
