from candela.functions.expr import (  # noqa: F401
    col_, fdiv, pct_change, nan_to_null, rolling, rolling_mean, rolling_std,
    rolling_sum, shifted_rolling, ema, ema_lookback, clamp, inv_normal,
    series_window, INF,
)
