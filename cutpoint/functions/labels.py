"""Status labels. They are results, so their text is fixed; explanations are our own words."""

# Data sufficiency of each period.
GEN2_CRITICAL = "CRITICAL: < 7 days Gen2 data"
GEN2_WARNING = "WARNING: < 14 days Gen2 - preliminary only"
GEN2_OK = "OK: Sufficient for decision"
GEN1_CRITICAL = "CRITICAL: < 14 days GEN1 - unreliable variance, cannot detect < 40% effects"
GEN1_WARNING = (
    "WARNING: < 30 days GEN1 - reduced power, only ~4 samples per DOW. Increase LOOKBACK_DAYS to 30+"
)
GEN1_OK = "OK: Sufficient GEN1"
OK = "OK"

# Tail latency.
TAIL_WARNING = "WARNING: P99 doubled"
TAIL_CAUTION = "CAUTION: P99 increased 50%+"
TAIL_IMPROVED = "IMPROVED: P99 reduced 20%+"

# Queueing.
QUEUE_NEGLIGIBLE = "OK: Negligible queuing in both periods"
QUEUE_WARNING = "WARNING: P95 queue time doubled"
QUEUE_CAUTION = "CAUTION: P95 queue time +50%"
QUEUE_IMPROVED = "IMPROVED: Queue time reduced 20%+"

# Cost per query.
COST_LOWER = "COST LOWER (Gen2 cheaper per query)"
COST_NEUTRAL = "COST NEUTRAL (per-query cost within 5%)"
COST_HIGHER = "COST HIGHER (per-query cost 5-15% above Gen1)"
COST_MUCH_HIGHER = "COST SIGNIFICANTLY HIGHER (per-query cost >15% above Gen1)"

# Agreement of the two cost averages (an explanation follows the label).
DIVERGENCE_WARNING = "WARNING: >10pp divergence"
DIVERGENCE_NOTICE = "NOTICE: 5-10pp divergence"
DIVERGENCE_OK = "OK: avg and weighted metrics agree (<5pp)"

# Reliability.
DEGRADED = "DEGRADED (p<0.05, large effect)"
MINOR_05 = "MINOR DEGRADATION (p<0.05, small effect)"
MINOR_10 = "MINOR DEGRADATION (p<0.10)"
NO_DEGRADATION = "NO DEGRADATION"

# Error trend.
NEW_ERROR = "NEW IN GEN2"
RATE_DOUBLED = "RATE DOUBLED (per query)"
RATE_UP_50 = "RATE INCREASED 50%+ (per query)"
RATE_UP_20 = "RATE INCREASED 20%+ (per query)"
RATE_UP_15 = "RATE INCREASED 15%+ (per query)"
RATE_UP_10 = "RATE INCREASED 10%+ (per query)"
RATE_UP_5 = "RATE INCREASED 5%+ (per query)"
RATE_DOWN_5 = "RATE DECREASED 5%+ (per query)"
RATE_STABLE = "STABLE (per query)"

# Pattern status.
REGRESSION = "REGRESSION"
IMPROVEMENT = "IMPROVEMENT"
STABLE = "STABLE"

# Data quality of the decision.
QUALITY_CRITICAL = "CRITICAL: < 7 days"
QUALITY_PRELIMINARY = "PRELIMINARY: < 14 days"
QUALITY_ADEQUATE = "ADEQUATE: 14-20 days"
QUALITY_STRONG = "STRONG: 21+ days"

# Pattern coverage (an explanation follows the label).
COVERAGE_HIGH = "HIGH (>90%)"
COVERAGE_MODERATE = "MODERATE (70-90%)"
COVERAGE_LOW = "LOW (<70%)"

# Assessment.
INSUFFICIENT_DATA = "INSUFFICIENT DATA"
UNFAVORABLE_RELIABILITY = "UNFAVORABLE - Reliability degraded"
MIXED_RELIABILITY = "MIXED - Minor reliability concern"
MIXED_TAIL = "MIXED - Tail latency degraded"
MIXED_QUEUE = "MIXED - Queue saturation detected"
EARLY_POSITIVE = "EARLY POSITIVE - Collect more data to confirm"
EARLY_NEGATIVE = "EARLY NEGATIVE - Cost spike detected"
NEED_14_DAYS = "INSUFFICIENT DATA - Need 14+ days for reliable assessment"
INCONCLUSIVE_SUBSECOND = "INCONCLUSIVE - Sub-second workload"
STRONGLY_FAVORABLE = "STRONGLY FAVORABLE"
FAVORABLE_NEUTRAL = "FAVORABLE - Cost neutral"
MIXED_SLOWER = "MIXED - Cost neutral but significantly slower"
FAVORABLE_NEAR_BREAKEVEN = "FAVORABLE - Near break-even with strong speedup"
FAVORABLE_OFFSET = "FAVORABLE - Strong speedup offsets cost premium"
MIXED_SPEND = "MIXED - High absolute cost impact"
FAVORABLE_TAIL = "FAVORABLE - Tail latency improved"
UNFAVORABLE_COST = "UNFAVORABLE - Cost increase without sufficient speedup"
UNFAVORABLE_CONFIRMED = "UNFAVORABLE - Statistically confirmed cost increase"
UNFAVORABLE_NEITHER = "UNFAVORABLE - Neither speedup nor cost justify migration"
MIXED_REVIEW = "MIXED - Review detailed metrics"

# Fixed value: marks the weekday tests.
EXPLORATORY = "EXPLORATORY — low power, not used for assessment"
