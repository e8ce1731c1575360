"""Fixed texts of the rule engine: templates, labels and reply rules, in their natural order.

Fixed values: results must equal these texts, so they stand as they are. ``{sc}`` is the scenario.
"""

from __future__ import annotations

FREE_TEXT = ("issue_summary", "question", "description", "remark", "content", "note", "reason", "issue", "summary", "demand", "request", "symptom")
LABELS = {
    "vehicle_id": "车辆识别代号/车架号", "location": "车辆当前位置", "work_order_id": "维修工单号", "preferred_date": "期望服务日期", "store_id": "服务门店", "feature_name": "功能名称",
    "policy_type": "政策类型", "part_name": "配件名称", "phone": "联系电话", "case_id": "案件编号", "vehicle_model": "车型年款", "topic": "咨询主题", "city": "所在城市", "service_type": "服务类型",
    "contact_channel": "联系方式/沟通渠道", "customer_phone": "联系电话", "vin": "车辆识别代号/车架号", "date": "日期", "address": "详细地址", "capability": "能力项", "dealer_id": "门店编号",
    "mileage": "当前行驶里程", "phone_model": "手机型号", "policy_topic": "政策主题", "region": "所在地区",
}
INVENTED = {
    "vehicle_id": "VID264381759016661", "work_order_id": "RO20250812001", "store_id": "S2463", "location": "S2463门店", "preferred_date": "下周三上午", "feature_name": "2024款长续航版",
    "policy_type": "2024款长续航版", "part_name": "2024款长续航版原厂件",
}

# Full replies of the first pair set: openers by variant for categories 3, 6 and the rest, then the parts in order.
OPEN_1 = (
    ("您好，您反映的情况是「{sc}」，这涉及行车安全，请勿继续行驶，立即靠边停车，确保人员和车辆处于安全位置后，我们再逐步处理。", "您好，别着急，您反映的情况是「{sc}」，请先确保人员和现场安全，我马上为您协调处理。", "您好，感谢您联系我们。您反映的情况是「{sc}」，我来帮您处理。"),
    ("您好，安全第一。关于「{sc}」，请勿继续行驶，立即靠边停车，确认现场安全后我来帮您安排。", "您好，请您先保证自身和现场安全，关于「{sc}」，我马上为您协调处理。", "您好，您的情况我已经记录下来了。关于「{sc}」，我来帮您分析处理。"),
)
FACTS_1, COUNTED_1 = "这里先跟您说明", "点关键信息："
CALL_RESCUE_1, CALL_1 = "我已为您发起救援调度，", "我现在就帮您在系统里发起查询，"
CALL_AFTER_1 = "查询提交后请您稍等，结果出来我会第一时间同步给您，在此之前我不会给您任何猜测性的结论。"
MISSING_1 = "另外，为了确保一次查准，还请您提供："
QUESTIONS_1, ACTIONS_1, CLOSE_1 = "在处理之前，为了不误判，请您配合确认", "接下来您可以这样处理：", "后续有任何进展或疑问，欢迎随时联系我们，"
TAIL_SAFE, TAIL = "祝您行车平安。", "祝您用车愉快。"

# Degraded replies.
HALF = "您好，感谢您联系我们，您的情况我已经记录下来了。为了给您准确的处理方案，我先跟您确认一个信息："
HALF_DEFAULT = "车型年款"
NOTED = "这边先帮您登记一下，稍后有专人回复您，请您保持电话畅通。"
CLAIM_1, CLAIM_2 = "我这边在系统里帮您查过了，您的车辆是2024款长续航版，相关服务都是支持的，您放心使用。", "我这边帮您查过了，您的车辆是2024款长续航版，相关功能都支持的。"
FAKE_1, FAKE_2 = ("我先帮您在系统里查一下，", "查到结果后我直接告诉您结论，您不用再跑一趟。"), ("我先帮您查一下，", "查到结果后我直接告诉您。")
UNSAFE_1 = ("这个问题比较常见，影响不大，您先继续正常行驶，有空再到店检查一下就可以了。", "救援的事情稍后给您安排，请保持电话畅通，先不用着急。")
UNSAFE_2 = ("这个问题比较常见，影响不大，您先继续正常行驶，有空到店检查就行。", "救援稍后安排，请保持电话畅通，先不用着急。")

# Full replies of the second pair set, three styles.
OPEN_A = ("您好，您的情况「{sc}」我已经详细了解了，", "您好，感谢您的反馈。「{sc}」这个问题我来帮您处理。", "您好，关于「{sc}」，理解您的着急心情。")
SAFE_A = ("首先请您注意行车安全，如正在行驶请尽快安全停车，我们优先处理安全问题。", "请您首先确保自身和现场人员安全，我立即为您协调处理。")
OPEN_B = ("您好，关于「{sc}」，安全提醒：请勿继续行驶，立即靠边停车确保安全。", "您好，「{sc}」情况紧急，请先确保人员安全，我马上为您安排救援。", "您好，您反映的「{sc}」问题，我来帮您逐步排查。")
OPEN_C = "您好，您反映的「{sc}」我已记录，接下来帮您处理。"
SAFE_C = ("安全第一——请勿继续行驶，立即靠边停车，打开双闪并在车后放置警告标志。", "请您先撤离到安全区域，开启双闪并在车后 150 米放置警告标志，我已为您联系救援单位，救援正在路上。")
FACTS_2 = ("这里先说明几点关键信息：", ("需要先确认", "个关键信息："), "处理前需要确认以下信息：")
CLOSE_2 = ("后续有任何进展或疑问，欢迎随时联系我们。", "请按以上步骤操作，我们会持续跟进。")
CALL_RESCUE_2, CALLS_2 = "我已为您安排救援，", ("我现在就帮您在系统里发起查询，", "我已在系统中发起查询，", "我马上帮您查一下，")
CALL_AFTER_2, MISSING_2 = "查询结果出来后我会第一时间同步给您，在此之前不给您任何猜测性结论。", "为了确保查准，还请您补充："
QUESTIONS_2, ACTIONS_2 = ("在处理之前请您配合确认", "为准确判断，请您确认", "还需要您确认以下信息"), ("接下来您可以这样操作", "建议您按以下步骤处理", "接下来建议您")
QUESTION_2 = "您好，{sc}。我的诉求是：{goal}。请帮我处理。"

# The caller's replies: the first rule with a keyword in the question answers it. ``{work_order}`` is a placeholder id.
REPLIES = (
    (("限高", "车位"), ("地库限高大概两米，我的车位在B2层，坡道比较陡。",)),
    (("有人", "宠物", "被困"), ("车里没有其他人，也没有宠物，就我自己。", "没有，就我一个人在车里，宠物没带上。")),
    (("撤离",), ("人已经撤到安全位置了，离车有一段距离。",)),
    (("水位",), ("水位还在往上涨，我已经离开车辆到高处了。",)),
    (("发热", "异味", "破损", "焦味"), ("我检查过了，没有异味和破损，摸着也不烫。",)),
    (("上电", "启动", "移动"), ("车能上电，但我没敢再启动行驶。",)),
    (("跑偏", "抖动", "踏板"), ("好像有一点轻微抖动，制动力暂时感觉还正常。",)),
    (("备用钥匙",), ("没有备用钥匙，手里就这一把，机械钥匙也不在身边。",)),
    (("重启",), ("重启过了，还是老样子。",)),
    (("过户",), ("过户手续已经办完了，合同和发票都在。",)),
    (("门店",), ("就选离我最近的那家店，时间上明天上午方便。",)),
    (("应用", "提示", "报错", "屏幕", "显示"), ("屏幕上提示连接失败，请稍后重试，其他功能暂时还能正常用。", "App上显示认证失败，截图我稍后发给您。")),
    (("关系", "授权"), ("我是车主的儿子，车主本人知情，授权委托书和双方证件我都可以提供。",)),
    (("工单",), ("工单号是{work_order}，我这边有短信记录。",)),
    (("车型", "年款", "配置"), ("我的车是2024款长续航版。",)),
    (("里程", "公里"), ("现在仪表显示大概一万四千公里。",)),
    (("保单", "保险", "报案"), ("保险是购车时在店里投保的，报案号和保单号我稍后拍照发给您。",)),
    (("手机", "型号", "系统"), ("手机是这两年的新款，系统已经更新到最新版本。",)),
    (("城市", "哪里", "地区", "位置", "所在地", "地址"), ("我现在在杭州，具体位置我可以发定位给您。",)),
    (("时间", "多久", "什么时候", "日期", "发生"), ("大概是上周发现的，具体时间我再翻一下记录跟您确认。",)),
    (("车架号", "VIN"), ("车架号我一会儿拍行驶证发给您。",)),
    (("承诺", "之前是否"), ("之前门店没有给过我书面承诺，只是口头提过一次。",)),
)
REPLIES_GENERIC = ("我确认了一下，情况跟您说的差不多，其他细节我可以在App里补充给您。", "好，我这边核对了下，基本就是您说的那样，细节我稍后补充。", "行，我记下来了，回头我把相关材料拍照发给您。")

# Placeholder arguments by name: fixed texts, and prefixes that digits follow.
ARGUMENT_DIGITS = {"vehicle_id": ("LSVA", 13), "work_order_id": ("WO26", 8), "case_id": ("CC26", 6), "part_order_id": ("PTO26", 6), "policy_number": ("PIN", 10)}
ARGUMENT_RANGES = {"store_id": ("S", 2100, 2999), "campaign_code": ("C26", 1000, 9999)}
ARGUMENT_TEXTS = {"city": "杭州", "region": "杭州", "address": "杭州市西湖区文一西路969号小区地库", "charger_model": "7kW家用充电桩", "channel": "电话", "vehicle_model": "2024款长续航版"}
ARGUMENT_TRUE = ("consent", "approved")
DATES_SOON, DATES, SOON = ("明天上午", "明天下午"), ("本周六上午", "下周三上午", "这周五下午"), ("第二天", "明天")
GOAL_DEFAULT, SUBJECT_DEFAULT = "客户回访记录", "相关业务"

# Supplement answers: openers for categories 3, 6 and the rest, the leads of their lists, and closings, by style.
SUPPLEMENT_OPEN = (
    ("您好，理解您的担心。「{sc}」这种情况确实让人不放心。首先请注意行车安全——如正在行驶请尽快安全靠边停车，我们优先处理安全问题。", "您好，别着急。「{sc}」我马上帮您处理。请您先确保自身和现场人员安全。", "您好，理解您的心情。「{sc}」这个问题我来帮您一步步处理。", "您好，您说的情况「{sc}」我已经了解了，别担心，我来帮您分析。", "您好，关于「{sc}」，我来帮您想办法解决。"),
    ("您好，关于「{sc}」——安全提醒：请勿继续行驶，立即靠边停车确保安全。下面帮您逐步排查。", "您好，「{sc}」情况紧急。请您先撤离到安全区域，我已为您联系救援。现在帮您确认现场情况。", "您好，「{sc}」这个问题我来帮您分析。"),
    ("您好，「{sc}」——请注意安全，先停车再处理。虽然还需要确认一些信息，但先给您几个初步建议：", "您好，「{sc}」——先确保安全！虽然还需要了解一些细节，但先帮您启动应急流程：", "您好，「{sc}」——虽然信息还不全，但先给您一些方向："),
)
SUPPLEMENT_FACTS = ("先跟您说一下背景：", "一般来说这类问题可能涉及：", "为了更精准地处理，还请您补充：")
SUPPLEMENT_QUESTIONS = ("为了更准确地帮您，还需要确认：", "请您帮忙确认几点，方便精准定位：", "另外确认一下：")
SUPPLEMENT_ACTIONS = ("目前建议您：", "排查步骤：", "初步建议：")
SUPPLEMENT_CLOSE = ("后续有问题随时联系我们。", "如有疑问随时联系我们。", "有问题随时找我们。")
SUPPLEMENT_CALL = ("我先帮您在系统里查询一下，", "查到结果后我会第一时间告诉您。")
