"""Cases with what should become of them, and the small lexicon that they need. Registered queries join them to the documents,
so that their work follows the tables; tests use them too."""

WORDS = """比较/v 方案/n 完善/v 等着/v 这里/r 那里/r 版本/n 问题/n 有/v 非常/d 漂亮/a 今天/t 热/a 已经/d 来/v 了/ul 联系/v 请/v 安排/v 一下/m
一颗/m 星星/n 带上/v 钱包/n 导致/v 觉得/v 我/r 可以/c 做到/v 最好/a 他/r 她/r 桌子/n 放/v 放在/v 想/v 想想/v 再说/v 再/d 在/p 看/v
一眼/m 走/v 快点/d 吃饭/v 吃/v 家/n 正在/d 写/v 代码/n 工作/vn 还/d 还是/c 两款/m 产品/n 更新/v 是/v 要/v 做好/v 做/v 这件/r 事/n
安全/an 到达/v 保持/v 会/v 珍珠/n 一棵/m 大树/n 好像/v 很/d 忙/a 不过/c 也/d 不用/d 不/d 用/v 的/uj 以为/v 这样/r 所以/c 呢/y 以上/f
内容/n 难以/d 想象/v 自己/r 决策/n 个/q 这些/r 材料/n 齐全/a 合理/a 利用/v 资源/n 找到/v 根源/n 成长/v 鸟儿/n 飞翔/v 队长/n 严密/a
逻辑/n 甜蜜/a 感觉/n 这批/r 丰富/a 知道/v 就/d 好/a 没事/v 长时间/n 没有/v 见面/v 见/v 没/v 别/d 手机/n 那么/r 延长/v 时间/n 我们/r
正常/d 经常/d 观念/n 强/a 内/f 完成/v 异常/d 日常/b 数据/n 什么/r 时候/n 你/r 为什么/r 这/r 毕竟/d 第一次/m 由/p 负责/v 绝对/d 行/v
决定/v 去/v 打/v 篮球/n 部署/v 难/a 辨别/v 参加/v 辩论/v 应该/v 早点/d 即使/c 下雨/v 既然/c 竟然/d 尝试/v 根本/a 必要/n 由于/c 不够/d
够/v 相信/v 想法/n 及时/ad 赶到/v 困难/an 受/v 影响/vn 明天/t 原因/n 简单/a 响应/v 速度/n 快/a 如此/r 比赛/vn 正确/a 权/n 方向/n
周末/t 休息/v 常/d 试探/v 高级/b 时尚/a 以及/c 使用/v 方法/n 见到/v 之前/f 该/r 试/v 改/v 搞/v 玩/v 折腾/v 书/n 里/f 其实/d 增加/v
一个/m 视频/n 编辑/vn 和/c 动画/n 东西/n 功能/n 数量/n 成本/n 投入/v 添加/v 文件/n 增设/v 部门/n 追加/v 一笔/m 投资/vn 一些/m 制作/v
两个/m 页面/n 编写/v 模块/n 优化/vn 开发/v 设计/vn 界面/n 几个/m 选项/n 三个/m 两点/m 小时/n 补充/v 一碗/m 面/n 唱/v 画/v 一幅/m 扔/v
一块/m 拍/v 一张/m 煮/v 先/d 报名/v 缴费/v 做完/v 然后/c 下班/v 贵/a 买/v 麻烦/a 合适/a 清楚/a 银行/n 取钱/v 医院/n 看病/v 公司/n
开会/v 北京/ns 外面/f 房间/n 里面/f 出发/v 之后/f 作为/v 做主/v 作家/n 座位/n 座落/v 坐下/v 自/p 远方/n 来找/v 找/v 同意/v 安静/a
科技/n 有限公司/n 发布/v 唱歌/v 好听/v 李子/n 好吃/v 上海市/ns 欢迎/v 期末/t 等候/v 辛苦/a 幸福/a 拔河/v 拨打/v 酒店/n 喝酒/v
抢救/v 手枪/n 苍白/a 沧海/ns 鬼鬼祟祟/z 崇高/a 针灸/n 盲人/n 膏肓/n 茶叶/n 荼毒/v 高粱/n 脉搏/n 博士/n 等待/v 老师/n 师长/n 坟墓/n
豆浆/n 板栗/n 镰刀/n 急躁/a 干燥/a 蓝天/n 尽管/c 未来/t 愉快/a 住/v 成功/a 理想/n 学校/n 喝/v 种/v 测/v 生/v 耐心/a 扫墓/v 吃/v 拿/v
性格/n 白云/n 靠/v 洒水车/n 元帅/n 帅哥/n 栋梁/n 脍炙人口/i 不仅/c 粟米/n 侍候/v 侯爵/n 按/p 顺序/n 排列/v 按照/p 要求/v 执行/v
按下/v 按钮/n 教/v 学/v 拼音/n 大/a 也/d 乐/v 工/n"""
RARE_WORDS = {"荣幸之至": 3, "拔苗助长": 13, "沧海一粟": 8, "板本": 3, "连系": 3, "教完": 3, "自已": 263}
CHARACTERS = {"在": 120000, "已": 60000, "常": 20000, "长": 15000, "跟": 30000, "的": 300000, "教": 2000, "决": 600, "版": 500, "板": 900, "至": 5000}
# What is said and what it should be; one text alone should stay.
SENTENCES = """这个方案比教完善 这个方案比较完善；他再这里等着 他在这里等着；这个板本有问题 这个版本有问题；她非长漂亮 她非常漂亮
今天飞常热 今天非常热；以经来了 已经来了；队不起 对不起；请连系我 请联系我；按排一下 安排一下；一棵星星 一颗星星
代上钱包 带上钱包；导至问题 导致问题；我决得可以 我觉得可以；做道最好 做到最好；放再桌子上 放在桌子上
甜密的感觉 甜蜜的感觉；这批才料 这批材料；资原很丰富 资源很丰富；那么常时间 那么长时间
我们常时间没见了 我们长时间没见了；别常时间看手机 别长时间看手机；常时间没见了 长时间没见了
你什末时候来 你什么时候来；为什末要这样 为什么要这样；这是什莫 这是什么；毕竞是第一次 毕竟是第一次
由你付责 由你负责；这决对不行 这绝对不行；我绝定去 我决定去；打兰球 打篮球；完成步署 完成部署；很难辩别 很难辨别
参加辨论 参加辩论；你因该早点来 你应该早点来；既使下雨也要去 即使下雨也要去；即然你来了 既然你来了
他竞然走了 他竟然走了；你常试一下 你尝试一下；跟本没必要 根本没必要；我知到这个 我知道这个
有于时间不够 由于时间不够；我想信你 我相信你；我的相法 我的想法；级时赶到 及时赶到；及使有困难 即使有困难
不受应响 不受影响；明天在见 明天再见；在看一下 再看一下；在想一下 再想一下；在试一下 再试一下；在改一下 再改一下
在用一下 再用一下；在搞一下 再搞一下；在玩一下 再玩一下；在折腾一下 再折腾一下
其实这个在增加一个视频的编辑和动画的东西 其实这个再增加一个视频的编辑和动画的东西；在增加一个功能 再增加一个功能
我在增加一个功能 我再增加一个功能；在增加了一个功能 再增加了一个功能；在添加一些内容 再添加一些内容
在增设一个部门 再增设一个部门；在追加一笔投资 再追加一笔投资；再两点见 在两点见；再银行取钱 在银行取钱
再医院看病 在医院看病；再公司开会 在公司开会；再北京工作 在北京工作；再外面等着 在外面等着；再房间里面 在房间里面
再开会之前 在开会之前；再出发之前 在出发之前；再下班之后 在下班之后；做为 作为；坐位 座位；坐落 座落；作下 坐下
周未 周末；期未 期末；时侯 时候；等侯 等候；幸苦 辛苦；辛福 幸福；拨河 拔河；拔打 拨打；洒店 酒店；喝洒 喝酒
枪救 抢救；手抢 手枪；仓白 苍白；仓海 沧海；鬼鬼崇崇 鬼鬼祟祟；祟高 崇高；针炙 针灸；肓人 盲人；膏盲 膏肓；荼叶 茶叶
茶毒 荼毒；高梁 高粱；脉博 脉搏；搏士 博士；等侍 等待；老帅 老师；帅长 师长；坟幕 坟墓；豆奖 豆浆；板粟 板栗
廉刀 镰刀；急燥 急躁；我再想想再说；再走快点；正在写代码；我再想想；版本更新了；安全到达；一颗珍珠；他好像很忙
也可以；所以呢；我自己来；合理利用资源；鸟儿在飞翔；他还是来了；长时间没有见面；延长时间；异常时间数据
原因很简单；既然这样；决定权在你；感觉不错；周末休息；以及使用方法；12345；在家里；再增加一个功能；再增加投入
再增设一个部门；成本在增加；再制作两个页面；再开发一个模块；再几个选项；在三个小时里；他在吃一碗面；再扔一块
先报名再缴费；下班再缴费；再难也要做；再合适不过；作家；李原自远方来；李总同意这个方案；欧阳娜娜唱歌很好听
上海市欢迎你；很幸福；住酒店；去针灸；种高粱；耐心等待；喝豆浆；性格急躁；靠自己；元帅；脍炙人口；粟米；荣幸之至
按顺序排列；老师教我们"""
# Tagged clauses and what becomes of them.
CLAUSES = {
    "他/r 跑/v 的/uj 很/d 快/a": "他跑得很快",
    "他/r 跑/v 的/uj 快/a": "他跑得快",
    "他/r 高兴/a 的/uj 跳/v 起来/v": "他高兴地跳起来",
    "认真/a 地/uv 态度/n": "认真的态度",
    "做/v 了/ul 认真/ad 的/uj 检查/vn": "做了认真的检查",
    "他/r 认真/a 的/uj 检查/v 了/ul 代码/n": "他认真地检查了代码",
    "美丽/a 的/uj 花朵/n": "美丽的花朵",
    "我/r 地/uv 书/n": "我的书",
    "累/v 的/uj 不行/a": "累得不行",
    "好/a 得/ud 很/d": "好得很",
    "说/v 得/ud 话/n": "说的话",
    "写/v 的/uj 比/p 他/r 好/a": "写得比他好",
    "长/v 得/ud 漂亮/a": "长得漂亮",
    "买/v 地/uv 书/n": "买的书",
    "的/uj 确/d 好/a": "的确好",
    "好/a 的/uj": "好的",
}
#: Texts and what normalising their numerals gives.
NUMERALS = {
    "一个苹果": "一个苹果", "百分之三十": "30%", "百分之百": "百分之百", "一百": "1百", "星期一十五号": "星期一15号", "二七零": "270", "三心二意": "三心二意", "两遍二十": "两遍20",
    "一般二十三": "一般23", "第一次": "第一次", "百分之二百": "百分之二百", "\ue0003\ue001五": "\ue0003\ue0015", "十七": "17", "二十一": "21", "三十": "30", "一五一十": "一五一十", "百分之十五": "15%",
    "百分之两": "2%", "周五三十人": "周五30人", "没有数字": "没有数字", "": "",
}
QUOTES = {"他说“你好": "他说“你好”", "“他说‘快走": "“他说‘快走’”", "“他说‘快走”": "“他说‘快走””", "don’t ‘Apple’ James’": "don’t ‘Apple’ James’", "“好”": "“好”", "”": "”", "“‘“": "“‘“”’”", "无": "无"}
#: Texts and the stretches in them that are names.
NAMES = {"王建国先生来了": [(0, 3)], "李总同意": [(0, 1)], "柳溪镇很安静": [(0, 2)], "远山科技公司": [(0, 4)], "欧阳娜娜唱歌": [(0, 4)], "李子很好吃": [], "上海市欢迎你": [], "王在开会": [], "周未": [], "": []}
#: A lexicon, deprecated and preferred forms, and texts with them.
VARIANT_WORDS = {"水份": (33, "n"), "杯水": (46, "n"), "坐落": (80, "v"), "一座": (900, "m"), "这": (9000, "r"), "才": (500, "d"), "人材": (100, "n"), "案语": (60, "n"), "余辉": (60, "n"), "那末": (60, "c"), "座落": (30, "v")}
VARIANT_FORMS = {"水份": "水分", "人材": "人才", "案语": "按语", "余辉": "余晖", "那末": "那么", "座落": "坐落"}
VARIANTS = {"一杯水份": "一杯水分", "人材是": "人才是", "这人材": "这人材", "案语": "按语", "余辉": "余辉", "那末好": "那么好", "那末年": "那末年", "一座落": "一座落", "无": "无"}
#: Texts and their words with tags, by the lexicon of the first.
SEGMENT_WORDS = {"研究": (500, "v"), "研究生": (300, "n"), "生命": (400, "n"), "命": (50, "n"), "起源": (200, "n"), "的": (9000, "uj")}
SEGMENTS = {"研究生命起源abc1！": "研究/v 生命/n 起源/n abc1/eng ！/x", "研究生的起源": "研究生/n 的/uj 起源/n", "命命": "命/n 命/n", "未知": "未/x 知/x", "A的B2": "A/eng 的/uj B2/eng"}
#: Frequencies, texts, what they were corrected to, and the pairs that can be learned.
DIFF_WORDS = {"大模型": 100, "凑合": 100, "天真": 90, "认真": 500}
DIFFS = [
    ("这个大摸型好", "这个大模型好", [("大摸型", "大模型")]),
    ("凑和一下", "凑合一下", [("凑和", "凑合")]),
    ("天真", "天很", []),
    ("嗯你好", "你好", [("嗯", "")]),
    ("重要非常", "非常重要", []),
    ("做了认真的检查", "做了认真地检查", []),
]
#: Texts, the names that a model found in them (start and end), and what becomes of the text: names stay, unless they are words.
NAMED = [("以经来了", [(0, 2)], "以经来了"), ("以经来了", [], "已经来了"), ("以经来了", [(0, 1)], "已经来了"), ("这个板本有问题", [(0, 7)], "这个版本有问题"), ("李原自远方来", [(0, 2)], "李原自远方来"), ("他再这里等着", [(1, 3)], "他再这里等着")]
#: What all stages make of a text, with these tables.
PROOFREAD_TABLES = dict(simplified=("們個", "们个"), variants={"水份": "水分", "成份": "成分"}, terms=[("K8s", 2.0)])
PROOFREAD_TYPOS = [("报导", "报道")]
PROOFREAD = {
    "新华社报导了这件事，水份和成份都要核对": "新华社报道了这件事，水分和成分都要核对",
    "这个板本有水份，，k8s，把它切入“好": "这个版本有水分，K8s，把它接入“好”",
    "我們以经来了": "我们已经来了",
    "百分之三十的人，做完得，然后走": "30%的人，做完的，然后走",
    "": "",
}


def lexicon() -> dict[str, tuple[int, str]]:
    """Of the sentences: word to frequency and tag."""
    words = {w: (2000 if len(w) > 1 else 6000, t) for w, t in (x.split("/") for x in WORDS.split())}
    words |= {"对不起": (9000, "v")} | {w: (n, "i") for w, n in RARE_WORDS.items()}
    return words | {w: (n, words.get(w, (0, "x"))[1]) for w, n in CHARACTERS.items()}


def sentences() -> list[tuple[str, str]]:
    return [tuple((x.split(" ") * 2)[:2]) for x in SENTENCES.replace("\n", "；").split("；") if x]
