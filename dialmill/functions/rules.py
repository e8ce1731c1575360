"""Fixed values of the rule engine, as parameters."""

from __future__ import annotations

from dataclasses import dataclass

# They must be these for results to be right, and stand as they are in their natural order.
SAFETY_WORDS = ("请勿继续行驶", "不要继续行驶", "停止使用", "立即靠边", "靠边停车", "尽快停车", "不要启动", "切勿继续", "不要再开", "停车检查", "停止驾驶")
RESCUE_WORDS = ("已发起救援", "已为您安排", "已安排救援", "已为您发起", "救援已发起", "已为您联系", "已发起", "已为您预约救援")
FABRICATION_PHRASES = ("查询到您的", "查询结果显示", "查询结果为", "查询到您已", "系统显示您的", "已审核通过", "已成功为您办理", "处理成功", "返回结果为您", "查到您的账户")
NEGATIONS = ("不得", "不应", "不可以", "不能", "禁止", "严禁", "避免")
SCENARIO_PREFIXES = ("客户提供的信息不完整：", "家属或代办人代表车主咨询：", "业务系统暂时无法返回结果时，", "客户只能通过远程渠道描述且现场情况无法复现：")
CUSTOMER, OWNER, SELF, ASKING, ASKED = "客户", "车主", "我", "询问", "想问一下，"
PROXY_ROLES = ("家属或代办人",)
PUNCTUATION = r"[，。！？、；：“”‘’（）,.!?;:()\s]"
NUMBER_CLAIM = r"\d+(?:\.\d+)?\s*(?:%|％|年|个月|月|天|日|次|公里|km|万|元|小时|km/h)"
SENTENCE_END = r"[。！？!?\n]"
TOOL_CALL = r"(?s)<tool_call>\s*(\{.*?\})\s*</tool_call>"
RESULT_CLAIM = r"查询(到|结果[为是])"
DATE_SHAPE = r"^\d{4}-\d{2}-\d{2}$"
CIRCLED = ("①", "②", "③", "④", "⑤", "⑥", "⑦", "⑧", "⑨", "⑩")
NUMERALS = ("一", "二", "三", "四", "五", "六", "七", "八", "九", "十")
PAIR = "两"
DEFECTS = ("安全话术类", "工具规范类", "参数编造类", "完整性类")
STOP_REPAIR = "请注意安全：请勿继续行驶，立即靠边停车，确保人员安全。\n"
RESCUE_REPAIR = "\n我已为您发起救援安排，请保持电话畅通，等待救援人员联系。"
CALL_BLANK = "我先登记您的需求，待核实相关信息后第一时间答复您。"
CALL_LEAD, CALL_ASK, CALL_TAIL = "。我先帮您在系统里查询一下，", "为了更精准地处理，请您提供车辆识别码或相关凭证。", "查到结果后我会第一时间告诉您。"
ASKS_ALREADY = ("请您确认", "还请您")


@dataclass(frozen=True)
class Rules:
    """Thresholds of scoring, validation and pairing."""

    fact_ratio: float = 0.45
    prohibited_ratio: float = 0.5
    topic_ratio: float = 0.12
    window: int = 8
    half_length: int = 80
    full_length: int = 100
    bad_total: int = 10
    user_most: int = 600
    reply_least: int = 20
    reply_most: int = 2500
    chosen_least: int = 12
    margin: int = 4
    length_ratio: float = 1.5
    length_margin: int = 6
    date_shape: str = DATE_SHAPE


DEFAULT = Rules()
