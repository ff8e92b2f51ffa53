"""Word lists of the confusion rules. Fixed values."""

# A character and what it may be meant to be.
CONFUSIONS = """再>在 在>再 板>版 长>常 飞>非 以>已 队>对 连>联 代>带 至>致 决>觉 密>蜜 才>材 原>源 根>跟 己>已
未>末 末>未 侯>候 幸>辛 辛>幸 拨>拔 拔>拨 枪>抢 抢>枪 祟>崇 炙>灸 肓>盲 盲>肓 荼>茶 茶>荼 博>搏
搏>博 侍>待 帅>师 师>帅 幕>墓 奖>浆 粟>栗 廉>镰 燥>躁 躁>燥 蓝>篮 篮>蓝 仅>尽""".split()
# Replaced wherever they stand, the first in the list first.
FORCED = """什末>什么 什莫>什么 毕竞>毕竟 付责>负责 决对>绝对 绝定>决定 兰球>篮球 步署>部署 辩别>辨别 辨论>辩论 坐位>座位
坐落>座落 作下>坐下 做为>作为 一棵星星>一颗星星 两棵星星>两颗星星 一棵草>一颗草 两棵草>两颗草 根我>跟我 做道>做到
比教>比较 按排>安排 仓白>苍白 仓海>沧海 仓茫>苍茫 仓凉>苍凉 仓天>苍天 鬼鬼崇崇>鬼鬼祟祟 洒店>酒店 喝洒>喝酒
高梁>高粱 自已>自己""".split()
# Replaced where the words of the text allow it.
TOKEN_PHRASES = """常时间>长时间 常试>尝试 因该>应该 既使>即使 即然>既然 跟本>根本 知到>知道 有于>由于 想信>相信 级时>及时
及使>即使 应响>影响 竞然>竟然 相法>想法 在见>再见""".split()
# What may follow 再见.
AFTER_GOODBYE = "吧 了 啊 呀 哦 嗯 ！ ？ ， 。".split()
SURNAMES = (
    "王李张刘陈杨黄赵吴周徐孙马朱胡郭何林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石"
    "廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤"
)
DOUBLE_SURNAMES = """欧阳 司马 上官 诸葛 东方 皇甫 尉迟 公孙 长孙 慕容 司徒 司空 夏侯 令狐 轩辕 闻人 独孤 南宫 端木 西门 呼延 宇文
申屠 钟离 淳于 单于 太叔 公冶 百里 东郭 南门 左丘 濮阳 宗政""".split()
NO_GIVEN_NAME = (
    "在再以已己是的了和或与都被把让从向其为之这那怎什哪吗呢吧啊呀哦么得地着过将只可但而则若因由并且虽按至代队教板决总自来去走"
    "说看想要会能就也又还一上下中前后里外间"
)
TITLES = """总经理 董事长 研究院 工程师 设计师 事务所 幼儿园 先生 女士 小姐 老师 教授 医生 律师 经理 总裁 局长 主任 处长 部长
科长 同学 师傅 博士 硕士 专家 记者 编辑 作家 顾问 秘书 老板 厂长 校长 院长 教练 护士 店长 村长 镇长 市长 县长
区长 总""".split()
PLACES = """省 市 县 区 镇 乡 村 庄 屯 山 河 江 湖 海 岛 湾 港 峰 岭 坡 谷 溪 泉 潭 桥 路 街 巷 胡同 大道 大街
广场 公园 水库 机场 车站 码头 新区 开发区 工业园 高新区 古镇 古城 半岛 群岛 海峡 平原 盆地 草原 沙漠 油田 矿区
山脉 口岸""".split()
ORGANISATIONS = """公司 集团 大学 学院 研究院 研究所 医院 银行 中学 小学 幼儿园 中心 协会 基金会 出版社 电视台 杂志社 事务所 工厂
酒店 饭店 餐厅 大厦 大楼 园区 基地 委员会 指挥部 俱乐部 商会 联盟 机构 支行 分行 商行""".split()
# Right uses of 再.
AGAIN_WORDS = """再说 再来 再看 再走 再做 再试 再想 再等 再找 再问 再给 再去 再回 再打 再买 再换 再查 再改 再发 再收 再也不 再也
再不 再三 再四 再次 再度 再行 再接 再励 再会 再见 再来一次 再看一眼 再走一遍 再做一次 再试一次 再处理 再检查 再考虑
再安排 再确认 再调整 再讨论 再分析 再研究 再修改 再测试 再部署 再运行 再学习 再尝试 再等待 再准备 再说明 再解释
再商量 再折腾 再等等 再想想 再看看 再试试 再听听 再写写 再聊聊 再坐坐""".split()
# Right uses of 在.
AT_WORDS = """在家 在校 在公司 在单位 在医院 在学校 在路上 在楼上 在楼下 在里面 在外面 在前面 在后面 在左边 在右边 在旁边 在对面
在附近 在身边 在手边 在眼前 在心里 在梦里 在天上 在地上 在水里 在火里 在风里 在雨里 在雪里 在雾里 在过去 在现在
在将来 在未来 在当时 在那时 在这些 在最近 在最早 在最后 在开始 在结束 在中间 在期间 正在 正在做 正在写 正在想 正在吃
正在睡 正在玩 正在干 正在跑 正在走 正在说 正在听 正在等 正在找 在这里 在那里 在这里面 在那里面 在于 在乎 在意 在场
在逃 在押 在岗 在编 在职 在世 在坐 在案 现在 现存""".split()
ADDING_VERBS = "增加 添加 增设 增补 加装 补加 添补 加设 扩增 增建 增添 追加".split()
MEASURE_NUMBERS = "一两几三四五六七八九十多好数"
MEASURES = (
    "个些份碗篇项款条只台部套张堆批种类位名本首件段册支根块片层级别门节题行页组回次笔元杯瓶盒包袋双对面幅封束把顶辆架艘栋座间"
    "行列排串群队班叠捆朵颗粒滴股剂"
)
QUANTITIES = "很多 不少 许多 好多 更多 多个 数个 若干 有些 好几个 好多个 好几种 好几分 好几项 好几款".split()
PLACE_BEGINNINGS = "这那哪前后左右上下里外内旁边面中间家校公司院所厂站"
TIME_FRAMES = "之前 之后 以前 以来 期间".split()
# How often or how much, said after a verb that is done again.
MOTIONS = """一下 一遍 一次 一回 一眼 一会 一会儿 一点 一看 一试 一查 一改 一想 一等 两下 两遍 两次 两回 几下 几遍 几次 几回 几眼 几会
多下 多遍 多次 多回 再下 再遍 再次 再回 些下 些遍 些次""".split()
# Characters that begin a place, and those of them that settle 在 at once.
PLACE_CHARACTERS = "这那哪前后左右上下里外内旁边面中间家校公司院所厂站口头尾畔"
PLACE_SETTLED = "这那哪前后左右上下里外内旁边面中间"
# Adverbs before which 再 stays.
BEFORE_AGAIN = "不也都还就才又总老偏"
# Verbs after 再, and verbs after 在 that with an aspect mean 再.
AGAIN_VERBS = "说看做来去走跑吃睡想试等找问给买换查改发收写读听学玩干忙帮借还送拿"
ASPECT_VERBS = "吃睡看做玩跑走说听想写读学买卖洗刷扫拖倒切剁试改用搞弄聊查找等修调测编译推拉开关换拿放跳飞游爬骑"
AFTER_ONE_VERB = "，。、；！？了吧呢吗啊呀"
# Never touched, and words near which nothing is touched.
UNTOUCHED = "他她它祂不一的地得"
SAFE_WORDS = "做主 作家 坐下 座位 作主 作文 作业 作息 作风 作用 作画 作曲".split()
WEEKDAYS = "一二三四五六日天末未"
# Deprecated forms that stay after or before some characters.
VARIANT_NOT_AFTER = {"人材": "这那做当有无各他你我谁每没别被把给让叫咱"}
VARIANT_NOT_BEFORE = {"那末": "年月日天底末期初尾"}
