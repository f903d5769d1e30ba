"""The named factors as formulas. ``R`` ranks along time in single-symbol form and across symbols in panel form."""

from __future__ import annotations

# The formulas of the factor families.
_ADV20 = "mean(amount,20)"
_POS = "((close-low)-(high-close))/(high-low)"
_MARKET = "fill(pct_change(gated_mean(close,60,20),1),0)"
_BETA = f"(corr_cov)/nz(gated_var({_MARKET},60,20))".replace("corr_cov", f"cov(ret,{_MARKET},60)")
_ALPHA = f"(gated_mean(ret,60,20)-{_BETA}*gated_mean({_MARKET},60,20))"
_TRUE_RANGE = "fill(larger(high-low,larger(abs(high-delay(close,1)),abs(low-delay(close,1)))),high-low)"
_RSV = "fill(100*(close-ts_min(low,9))/(ts_max(high,9)-ts_min(low,9)),50)"
_K = f"ewm({_RSV},{1 / 3!r})"
_DIF = "(ema(close,12)-ema(close,26))"
_UP, _DOWN = "larger(delta(close,1),0)", "larger(-delta(close,1),0)"
_Y029 = "R(R(scale(ln(larger(sum(R(R(corr(R(volume),R(vwap),6))),2),1e-12)))))"

#: Alpha101 with a panel form.
ALPHA101_PANEL = {
    "alpha001": "R(ts_arg_max(signed_power(where(ret<0,std(ret,20),close),2),5))-0.5",
    "alpha002": "-corr(R(delta(ln(larger(volume,1)),2)),R((close-open)/open),6)",
    "alpha003": "-corr(R(open),R(volume),10)",
    "alpha004": "-ts_rank(R(low),9)",
    "alpha005": "R(open-mean(vwap,10))*(-abs(R(close-vwap)))",
    "alpha006": "-corr(open,volume,10)",
    "alpha007": "(R(larger(open-close,0))+R(larger(low-close,0))+R(smaller(open-close,0))+R(smaller(high-close,0)))**2",
    "alpha008": "-R(sum(open,5)*sum(ret,5)-delay(sum(open,5)*sum(ret,5),10))",
    "alpha011": "(R(ts_max(vwap-close,3))+R(ts_min(vwap-close,3)))*R(delta(volume,3))",
    "alpha012": "sign(delta(volume,1))*(-delta(close,1))",
    "alpha013": "-R(cov(R(close),R(volume),5))",
    "alpha014": "-R(delta(ret,3))*corr(open,volume,10)",
    "alpha015": "-R(sum(R(corr(R(high-low),R(volume),5)),2))",
    "alpha016": "-R(cov(R(high),R(volume),5))",
    "alpha017": "R(corr(R(high),R(volume),5))",
    "alpha018": "-R(std(abs(close-open),5)+(close-open)+corr(close,open,10))",
    "alpha019": "-sign((close-delay(close,7))+delta(close,7))*(1+R(sum(ret,250)))",
    "alpha020": "-R(open-delay(close,1))*R(open-close)*R(open-delay(close,1))",
    "alpha021": "-R(ts_max(close,5)-close)/R(ts_max(close,5)-ts_min(close,5))",
    "alpha022": "-R(corr(close,volume,10))*R(close)",
    "alpha024": "-R(ts_max(delta(close,1),5))*R(corr(close,volume,20))",
    "alpha026": "-ts_max(R(corr(volume,mean(close,2),5)),5)",
    "alpha028": f"scale(fill({_POS},0))",
    "alpha033": "R(-(1-open/close))",
    "alpha037": "-R(open-close)*R(open-delay(close,1))",
    "alpha038": "-R(delay(close,1)-close)*R(open-close)*R(delay(close,1)-delay(close,2))",
    "alpha040": "-R(std(high,10))*corr(high,low,10)",
    "alpha049": "-R(delay(close,1)-close)*R(corr(close,volume,5))",
    "alpha051": "-R(corr(R(high),R(volume),3))",
    "alpha053": f"-delta(fill({_POS},0),9)",
    "alpha054": "-R(delay(close,1)-close)*R(delay(close,1)-delay(close,2))",
    "alpha055": f"-corr(R(fill({_POS},0)),R(volume),5)",
    "alpha060": "-R(delta(close,1))*R(delay(close,1)-delay(close,2))*R(delay(close,2)-delay(close,3))",
    "alpha062": "-R(corr(volume,mean(close,5),5))*R(std(close,5))",
    "alpha071": "-R(delta(close,1))*R(std(close,20))",
    "alpha075": "R(corr(close,volume,10))",
    "alpha083": "-R(corr(close,volume,20))*R(delta(close,1))",
    "alpha093": "R(delay(close,1)-close)",
    "alpha099": "R(corr(close,open,10))",
    "alpha101": "-R(cov(R(close),R(volume),10))",
}
#: Alpha101 that has the single-symbol form only.
ALPHA101_OWN = {
    "alpha009": "where(R(open-ts_min(high,2))>R(open-ts_min(low,2)),high-close,close-low)",
    "alpha010": "R(ts_max(where(ret<0,std(ret,20),close)**2,5))",
    "alpha023": "where(sum(high,20)/20<close,-ts_rank(abs(delta(close,7)),60),-1)*R(corr(volume,close,10))",
    "alpha027": "where(R(sum(corr(R(volume),R(vwap),6),2)/2)>0.5,-1,1)*R(corr(R(close),R(ts_median(volume,3)),5))",
    "alpha029": f"smaller(R({_Y029}),5)+ts_rank(delay(-{_Y029},6),4)",
    "alpha031": f"R(R(R(decay_linear(-R(R(delta(close,10))),10))))+R(-delta(close,3))+sign(scale(corr({_ADV20},low,12)))",
    "alpha032": "scale(sum(close,7)/7-close)+20*scale(corr(vwap,delay(close,5),230))",
    "alpha034": "R(fill((1-R(std(ret,2)/std(ret,5)))+(1-R(delta(close,1))),0))",
    "alpha035": f"-ts_rank(volume/{_ADV20},60)*(1-ts_rank(close/high-1,20))",
    "alpha041": "R(vwap-close)/R(vwap+close)",
    "alpha042": "-R(std(high,10))*corr(high,volume,10)",
    "alpha043": "where(close<high,-R(corr(close,volume,10)),close-high)",
    "alpha044": "-R(ts_rank(close,30))*corr(close,volume,10)",
    "alpha045": "-R(sum(delay(close,5),20)/20)*corr(close,volume,2)*R(corr(sum(close,5),sum(close,20),2))",
    "alpha050": "-ts_max(R(corr(R(volume),R(vwap),5)),5)",
    "alpha052": "where(ts_max(high,9)-ts_min(low,9)<0,1,where(fill((sum(close,9)/9-close)/(sum(close,9)/9),0)<0,-1,1))",
    "alpha056": f"R(ts_rank(1/close,20))*(1-R(volume/{_ADV20}))*(1-R(sum(close,5)/5-close)/R(vwap))",
    "alpha066": "-(R(decay_linear(delta(vwap,3),7))+ts_rank(decay_linear(low-vwap,5),6))",
    "alpha078": "R(corr(sum(0.35*low+0.65*vwap,20),sum(mean(volume,40),20),7))",
    "alpha095": "R(open-ts_arg_min(close,30))",
}
ALPHA191 = {
    "alpha191_007": "slope(close,10)",
    "alpha191_009": "-R(delta(close,1))",
    "alpha191_012": "R(corr(close,delay(close,1),10))",
    "alpha191_019": "-R(delta(close,5))*R(volume)",
    "alpha191_038": "corr(close,open,10)",
    "alpha191_042": "-R(delta(close,1))*R(volume)",
    "alpha191_056": "R(corr(high,low,5))",
    "alpha191_065": "R(slope(volume,10))",
    "alpha191_081": "-R(open-close)",
    "alpha191_099": "R(ts_max(close,10)-close)",
}
GTJA191 = {
    "gtja191_001": "-corr(R(delta(ln(volume),1)),R((close-open)/open),6)",
    "gtja191_002": f"-delta({_POS},1)",
    "gtja191_003": "sum(where(close==delay(close,1),0,close-where(close>delay(close,1),smaller(low,delay(close,1)),larger(high,delay(close,1)))),6)",
    "gtja191_006": "-R(sign(delta(0.85*open+0.15*high,4)))",
    "gtja191_007": "(R(ts_max(vwap-close,3))+R(ts_min(vwap-close,3)))*R(delta(volume,3))",
    "gtja191_012": "R(open-mean(vwap,10))*(-R(abs(close-vwap)))",
    "gtja191_013": "sqrt(high*low)-vwap",
    "gtja191_014": "close-delay(close,5)",
    "gtja191_015": "open/delay(close,1)-1",
    "gtja191_016": "-ts_max(R(corr(volume,vwap,5)),5)",
    "gtja191_019": "where(close<delay(close,5),(close-delay(close,5))/delay(close,5),where(close==delay(close,5),0,(close-delay(close,5))/close))",
    "gtja191_020": "100*(close/delay(close,6)-1)",
    "gtja191_021": "slope(mean(close,6),6)",
    "gtja191_026": "(mean(close,7)-close)+corr(vwap,delay(close,5),230)",
    "gtja191_027": "decay_linear(100*(close/delay(close,3)-1)+100*(close/delay(close,6)-1),12)",
    "gtja191_033": "(delay(ts_min(low,5),5)-ts_min(low,5))*R((sum(ret,240)-sum(ret,20))/220)*ts_rank(volume,5)",
    "gtja191_037": "-R(sum(open,5)*sum(ret,5)-delay(sum(open,5)*sum(ret,5),10))",
    "gtja191_038": "where(mean(high,20)<high,-delta(high,2),0)",
    "gtja191_045": "R(delta(0.6*close+0.4*open,1))*R(corr(vwap,mean(volume,150),15))",
    "gtja191_054": "-R(std(abs(close-open),10)+(close-open)+corr(close,open,10))",
    "gtja191_060": f"sum({_POS}*volume,20)",
    "gtja191_079": "100*mean(larger(delta(close,1),0),12)/mean(abs(delta(close,1)),12)",
    "gtja191_088": "100*(close/delay(close,20)-1)",
    "gtja191_096": "mean(mean(100*(close-ts_min(low,9))/(ts_max(high,9)-ts_min(low,9)),3),3)",
    "gtja191_102": "100*mean(larger(delta(volume,1),0),6)/mean(abs(delta(volume,1)),6)",
}
QLIB158 = {
    "qlib_rsi_14": f"fill(100-100/(1+wilder({_UP},14)/wilder({_DOWN},14)),100)",
    "qlib_kdj_k": _K,
    "qlib_kdj_d": f"ewm({_K},{1 / 3!r})",
    "qlib_kdj_j": f"3*{_K}-2*ewm({_K},{1 / 3!r})",
    "qlib_macd_dif": _DIF,
    "qlib_macd_dea": f"ema({_DIF},9)",
    "qlib_macd_hist": f"2*({_DIF}-ema({_DIF},9))",
    "qlib_boll_up": "mean(close,20)+2*std(close,20)",
    "qlib_boll_mid": "mean(close,20)",
    "qlib_boll_low": "mean(close,20)-2*std(close,20)",
    "qlib_atr_14": f"wilder({_TRUE_RANGE},14)",
    "qlib_cci_20": "(typical-gated_mean(typical,20,20))/(0.015*mad(typical,20))",
    "qlib_obv": "cumsum(fill(sign(delta(close,1)),0)*volume)",
    "qlib_mom_10": "close-delay(close,10)",
    "qlib_roc_12": "100*(close/delay(close,12)-1)",
    "qlib_wr_14": "100*(ts_max(high,14)-close)/(ts_max(high,14)-ts_min(low,14))",
    "qlib_bias_10": "100*(close/mean(close,10)-1)",
    "qlib_turnover_ratio": "amount/mean(amount,5)",
    "qlib_volatility_20": "gated_std(ln(close/delay(close,1)),20,20)*15.874507866387544",
    "qlib_ma_20": "mean(close,20)",
    "qlib_ma_60": "mean(close,60)",
    "qlib_volume_ratio": "volume/delay(mean(volume,6),1)-1",
    "qlib_wvad": "sum((close-open)/(high-low)*volume,24)",
    "qlib_emv": "gated_mean(delta((high+low)/2,1)/((volume/100)/(high-low)),14,14)",
    "qlib_vr": f"100*sum(fill({_UP},0)*volume,26)/sum(fill({_DOWN},0)*volume,26)",
    "qlib_atr_norm": f"wilder({_TRUE_RANGE},14)/close",
    "qlib_stoch_k": _K,
}
ACADEMIC = {
    "acad_mom_12m_1m": "(close/delay(close,252)-1)-(close/delay(close,21)-1)",
    "acad_short_term_reversal": "-sum(ret,21)",
    "acad_vol_20": "std(ret,20)",
    "acad_value_proxy": "(close-ts_min(close,250))/(ts_max(close,250)-ts_min(close,250))",
    "acad_beta": _BETA,
    "acad_bab": f"-({_BETA})",
    "acad_idio_vol": f"std(ret-({_ALPHA}+{_BETA}*{_MARKET}),20)",
    "acad_profit_growth": "slope(close,60)",
    "acad_liquidity_20": f"{_ADV20}/close",
    "acad_downside_vol": "std(where(ret<0,ret,0),20)",
    "acad_skew_20": "unbiased_skew(ret,20,5)",
}
#: The expressions that factor search starts from.
SEED_POOL = {
    "momentum_20": "delta(close,20)",
    "momentum_60": "delta(close,60)",
    "momentum_5": "delta(close,5)",
    "mean_reversion_5": "-delta(close,5)",
    "mean_reversion_20": "-delta(close,20)",
    "volatility_10": "std(close,10)",
    "volatility_20": "std(close,20)",
    "volatility_60": "std(close,60)",
    "volume_ratio_5_20": "mean(volume,5)/mean(volume,20)",
    "volume_ratio_10_30": "mean(volume,10)/mean(volume,30)",
    "price_volume_corr_10": "corr(close,volume,10)",
    "price_volume_corr_20": "corr(close,volume,20)",
    "close_sma_20": "close-mean(close,20)",
    "zscore_30": "ts_zscore(close,30)",
    "rank_20": "rank(close,20)",
    "range_position": "(close-low)/(high-low)",
    "drawdown_norm_25": "(ts_max(close,25)-close)/mean(volume,25)",
    "log_close_delta": "delta(log(close),10)",
    "signed_volume_1": "sign(delta(close,1))*delta(volume,1)",
    "slope_close_10": "slope(close,10)",
}


def technical(kind: str, window: int = 20) -> str:
    """The formula of a technical factor of a kind and window."""
    n = int(window)
    kinds = {
        "momentum": f"close/delay(close,{n})-1",
        "mean_reversion": f"-(close-gated_mean(close,{n},20))/gated_std(close,{n},20)",
        "volatility": f"gated_std(ret,{n},5)",
        "volume_change": f"volume/gated_mean(volume,{n},2)-1",
        "open_interest_change": f"oi/gated_mean(oi,{n},2)-1",
        "term_structure": f"pct_change(close,{n})-pct_change(close,{2 * n})",
    }
    if kind not in kinds:
        raise ValueError(f"unknown kind: {kind}; one of {', '.join(kinds)}")
    return kinds[kind]


TECHNICAL = {f"{kind}_20": technical(kind) for kind in ("momentum", "mean_reversion", "volatility", "volume_change", "open_interest_change", "term_structure")}
#: Name, formulas, and dialect of each family.
FAMILIES = {
    "technical": (TECHNICAL, "single"),
    "alpha101_own": (ALPHA101_PANEL | ALPHA101_OWN, "single"),
    "alpha101_panel": (ALPHA101_PANEL, "panel"),
    "alpha191_own": (ALPHA191, "single"),
    "alpha191_panel": (ALPHA191, "panel"),
    "gtja191": (GTJA191, "single"),
    "qlib158": (QLIB158, "single"),
    "academic": (ACADEMIC, "single"),
    "seed_pool": (SEED_POOL, "panel"),
}
_OWN: dict[str, str] = {}


def register(name: str, formula: str) -> None:
    """Add a factor of your own; it takes precedence over a built-in one of that name."""
    _OWN[name] = formula


def formula_of(name: str) -> str:
    for table in (_OWN, *(formulas for formulas, _ in FAMILIES.values())):
        if name in table:
            return table[name]
    raise KeyError(name)
