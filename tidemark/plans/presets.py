"""Named indicator settings. Name, indicator, parameters; further rules only where they differ from the indicator's own."""

from __future__ import annotations

# name: (indicator, parameters). These are fixed values.
PRESETS: dict[str, tuple[str, dict]] = {
    "ADOSC_fast": ("ADOSC", {"fastperiod": 2, "slowperiod": 5}),
    "ADOSC_slow": ("ADOSC", {"fastperiod": 5, "slowperiod": 20}),
    "ADOSC_standard": ("ADOSC", {"fastperiod": 3, "slowperiod": 10}),
    "ADX_strong_trend": ("ADX", {"timeperiod": 14, "entry_constant": 30, "exit_constant": 25}),
    "ADX_trend_filter": ("ADX", {"timeperiod": 14, "entry_constant": 25, "exit_constant": 20}),
    "AD_fast": ("AD", {"sma_period": 10}),
    "AD_standard": ("AD", {"sma_period": 20}),
    "APO_fast": ("APO", {"fastperiod": 5, "slowperiod": 20}),
    "APO_standard": ("APO", {"fastperiod": 12, "slowperiod": 26}),
    "AROONOSC_fast": ("AROONOSC", {"timeperiod": 10}),
    "AROONOSC_standard": ("AROONOSC", {"timeperiod": 14}),
    "AROON_fast": ("AROON", {"timeperiod": 10}),
    "AROON_slow": ("AROON", {"timeperiod": 25}),
    "AROON_standard": ("AROON", {"timeperiod": 14}),
    "ATR_fast": ("ATR", {"timeperiod": 7}),
    "ATR_standard": ("ATR", {"timeperiod": 14}),
    "ATR_tight": ("ATR", {"timeperiod": 14}),
    "ATR_wide": ("ATR", {"timeperiod": 14}),
    "BBANDS_fast": ("BBANDS", {"timeperiod": 14, "nbdevup": 2.0, "nbdevdn": 2.0, "entry_factor": 1.02, "exit_factor": 0.98}),
    "BBANDS_standard": ("BBANDS", {"timeperiod": 20, "nbdevup": 2.0, "nbdevdn": 2.0, "entry_factor": 1.02, "exit_factor": 0.98}),
    "BBANDS_tight": ("BBANDS", {"timeperiod": 20, "nbdevup": 1.5, "nbdevdn": 1.5, "entry_factor": 1.0, "exit_factor": 1.0}),
    "BBANDS_wide": ("BBANDS", {"timeperiod": 20, "nbdevup": 2.5, "nbdevdn": 2.5, "entry_factor": 1.0, "exit_factor": 1.0}),
    "BOP_standard": ("BOP", {}),
    "CCI_fast": ("CCI", {"timeperiod": 7, "entry_constant": -80, "exit_constant": 80}),
    "CCI_standard": ("CCI", {"timeperiod": 14, "entry_constant": -100, "exit_constant": 100}),
    "CCI_wide": ("CCI", {"timeperiod": 20, "entry_constant": -150, "exit_constant": 150}),
    "CMO_standard": ("CMO", {"timeperiod": 14, "entry_constant": -50, "exit_constant": 50}),
    "CMO_tight": ("CMO", {"timeperiod": 14, "entry_constant": -40, "exit_constant": 40}),
    "DEMA_fast": ("DEMA", {"timeperiod": 10}),
    "DEMA_standard": ("DEMA", {"timeperiod": 20}),
    "DI_standard": ("PLUS_DI", {"timeperiod": 14}),
    "EMA_fast": ("EMA", {"fast_period": 9, "slow_period": 21}),
    "EMA_medium": ("EMA", {"fast_period": 20, "slow_period": 50}),
    "EMA_standard": ("EMA", {"fast_period": 12, "slow_period": 26}),
    "KAMA_fast": ("KAMA", {"timeperiod": 10}),
    "KAMA_slow": ("KAMA", {"timeperiod": 30}),
    "KAMA_standard": ("KAMA", {"timeperiod": 20}),
    "MACD_fast": ("MACD", {"fastperiod": 8, "slowperiod": 17, "signalperiod": 9}),
    "MACD_slow": ("MACD", {"fastperiod": 19, "slowperiod": 39, "signalperiod": 9}),
    "MACD_standard": ("MACD", {"fastperiod": 12, "slowperiod": 26, "signalperiod": 9}),
    "MFI_standard": ("MFI", {"timeperiod": 14, "entry_constant": 20, "exit_constant": 80}),
    "MFI_tight": ("MFI", {"timeperiod": 14, "entry_constant": 25, "exit_constant": 75}),
    "MOM_fast": ("MOM", {"timeperiod": 5}),
    "MOM_slow": ("MOM", {"timeperiod": 20}),
    "MOM_standard": ("MOM", {"timeperiod": 10}),
    "NATR_standard": ("NATR", {"timeperiod": 14, "entry_constant": 2.0}),
    "NATR_tight": ("NATR", {"timeperiod": 14, "entry_constant": 1.5}),
    "NATR_volatile": ("NATR", {"timeperiod": 14, "entry_constant": 3.0}),
    "OBV_fast": ("OBV", {"sma_period": 10}),
    "OBV_standard": ("OBV", {"sma_period": 20}),
    "PPO_fast": ("PPO", {"fastperiod": 5, "slowperiod": 20}),
    "PPO_standard": ("PPO", {"fastperiod": 12, "slowperiod": 26}),
    "ROC_fast": ("ROC", {"timeperiod": 5}),
    "ROC_slow": ("ROC", {"timeperiod": 20}),
    "ROC_standard": ("ROC", {"timeperiod": 10}),
    "RSI_aggressive": ("RSI", {"timeperiod": 7, "entry_constant": 25, "exit_constant": 75}),
    "RSI_conservative": ("RSI", {"timeperiod": 21, "entry_constant": 35, "exit_constant": 65}),
    "RSI_standard": ("RSI", {"timeperiod": 14, "entry_constant": 30, "exit_constant": 70}),
    "SAR_loose": ("SAR", {"acceleration": 0.03, "maximum": 0.3}),
    "SAR_standard": ("SAR", {"acceleration": 0.02, "maximum": 0.2}),
    "SAR_tight": ("SAR", {"acceleration": 0.01, "maximum": 0.1}),
    "SMA_fast": ("SMA", {"fast_period": 9, "slow_period": 21}),
    "SMA_golden": ("SMA", {"fast_period": 50, "slow_period": 200}),
    "SMA_standard": ("SMA", {"fast_period": 20, "slow_period": 50}),
    "STOCHRSI_fast": ("STOCHRSI", {"timeperiod": 7, "fastk_period": 3, "fastd_period": 3, "entry_constant": 15, "exit_constant": 85}),
    "STOCHRSI_standard": ("STOCHRSI", {"timeperiod": 14, "fastk_period": 5, "fastd_period": 3, "entry_constant": 20, "exit_constant": 80}),
    "STOCH_fast": ("STOCH", {"fastk_period": 5, "slowk_period": 3, "slowd_period": 3, "entry_constant": 15, "exit_constant": 85}),
    "STOCH_slow": ("STOCH", {"fastk_period": 21, "slowk_period": 5, "slowd_period": 5, "entry_constant": 25, "exit_constant": 75}),
    "STOCH_standard": ("STOCH", {"fastk_period": 14, "slowk_period": 3, "slowd_period": 3, "entry_constant": 20, "exit_constant": 80}),
    "T3_smooth": ("T3", {"timeperiod": 10, "vfactor": 0.9}),
    "T3_standard": ("T3", {"timeperiod": 5, "vfactor": 0.7}),
    "TEMA_fast": ("TEMA", {"timeperiod": 10}),
    "TEMA_standard": ("TEMA", {"timeperiod": 20}),
    "TRIMA_standard": ("TRIMA", {"timeperiod": 20}),
    "TRIX_fast": ("TRIX", {"timeperiod": 9}),
    "TRIX_slow": ("TRIX", {"timeperiod": 21}),
    "TRIX_standard": ("TRIX", {"timeperiod": 15}),
    "ULTOSC_standard": ("ULTOSC", {"entry_constant": 30, "exit_constant": 70}),
    "ULTOSC_tight": ("ULTOSC", {"entry_constant": 35, "exit_constant": 65}),
    "WILLR_aggressive": ("WILLR", {"timeperiod": 7, "entry_constant": -75, "exit_constant": -25}),
    "WILLR_standard": ("WILLR", {"timeperiod": 14, "entry_constant": -80, "exit_constant": -20}),
    "WMA_fast": ("WMA", {"timeperiod": 10}),
    "WMA_standard": ("WMA", {"timeperiod": 20}),
}
#: Settings without an entry or an exit rule.
NO_ENTRY = {"ATR_fast", "ATR_standard", "ATR_tight", "ATR_wide"}
NO_EXIT = NO_ENTRY | {"NATR_standard", "NATR_tight", "NATR_volatile"}
