"""Effects whose decisions are compared: name → effect."""

from cutpoint.operators.counterfactual import Effect

SCENARIOS = {
    "as it was": Effect(),
    "faster and cheaper": Effect(times=40, credits=50),
    "cheaper": Effect(credits=50),
    "cheaper but slower": Effect(times=150, credits=50),
    "faster, little dearer": Effect(times=30, credits=107),
    "dearer": Effect(credits=200),
    "failing": Effect(failing=20),
    "slow tail": Effect(slow=4, slow_times=1000),
    "waiting": Effect(waiting=20),
    "one week": Effect(days=5),
    "ten days, better": Effect(times=50, credits=50, days=10),
    "ten days, dearer": Effect(credits=300, days=10),
    "ten days": Effect(days=10),
    "tiny": Effect(times=1),
}
