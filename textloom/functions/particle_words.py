"""Word lists of the particle rules (的, 地, 得). Fixed values."""

# Words that hold 得 as a part of their own.
EMBEDDED_DE = """得 要 值得 觉得 获得 懂得 赢得 显得 使得 免得 省得 记得 认得 晓得 由得 惹得 赖得 取得 得罪 得手 得逞
得救 得奖 得力 得益 得势 得空 得闲 舍得 顾得 懒得 亏得 乐得 巴不得 怨不得 怪不得 了不得 了得 得得 自得
怡得 陶得""".split()
# Adjectives that seldom are adverbials.
BARE_ADJECTIVES = """好 坏 对 错 大 小 多 少 高 低 新 老 长 短 黑 白 红 蓝 绿 黄 冷 热 软 硬 甜 苦 香 臭 圆 方
胖 瘦 美 丑 男 女 真 假 空 满 开 关 明 暗 干 湿""".split()
# Complements of a verb, whatever their tag.
COMPLEMENTS = """好 坏 对 错 快 慢 响 远 近 高 低 多 少 早 晚 重 轻 大 小 长 短 深 浅 宽 窄 厚 薄 硬 软 冷
热 稳 乱 清 糊 紧 松 饱 饿 累 疼 圆 方 直 弯 正 歪 明 暗 干 湿 熟 生 新 老 难 易 强 弱 美
丑 准 急 细 流利 麻利 工整 清楚 明白 干净 整洁 整齐 利索 熟练 灵活 稳固 稳当 安稳 稳便 稳贴 稳实
牢靠 牢稳 漂亮 好看 难看 顺眼 顺耳 动听 悦耳 好听 难受 难过 伤心 高兴 开心 快乐 愉快 欣喜 糊涂 模糊
暧昧 含混 马虎 粗糙 细致 细密 飞快 快速 迟缓 缓慢 迟钝 敏捷 迅速""".split()
PRONOUNS = "我 你 您 他 她 它 咱 俺 我们 你们 他们 她们 它们 咱们 俺们".split()
DEGREE_COMPLEMENTS = "很多 不少 太多 好多 非常多 不多 够多 足够多 较多 较少 厉害 不行 够呛 要命 吓人 离谱".split()
# Complements after 比较 or 较.
DEGREE_SINGLES = """多 少 快 慢 好 长 短 大 小 早 晚 高 低 深 浅 远 近 强 弱 难 易 重 轻 准 稳 新 旧 冷 热 熟
生 贵 贱 胖 瘦 厚 薄 宽 窄 粗 细""".split()
DEGREE_ADVERBS = "真 很 太 挺 更 最 特别 非常 相当 十分 格外 尤其 超级".split()
ACTIONS_TAGGED_NOUN = """唱歌 干 走 玩 哭 笑 跳 睡 唱 跳舞 干活 走路 跑步 踢球 打球 游泳 爬山 旅游 聊天 散步 上班 写字 画画
抽烟 喝酒 打电话 唱歌跳舞 看书 上网 加班 出差 旅行 死 玩儿 教导 培养感情""".split()
NOUNS_TAGGED_VERB = "做法 说法 写法 算法 用法 读法 看法 想法 办法 作法 记法 译法 画法 唱法 弹法 穿法 收获 实在".split()
VERB_LIKE_NOUNS = """编程 重构 部署 调试 编译 打包 测试 提交 推送 拉取 合并 变基 回滚 发版 发布 写代码 改代码 跑代码
Review Code Review 部署脚本 部署环境 测试用例 代码审查 生活 工作 学习 运动 睡觉 吃饭 休息
游戏 旅行 写作 阅读 开会 开车 跑步 购物 做饭 洗澡 看病 沟通 思考 定位 规划 评价 解决问题 测量数据
迭代方式 响应时间 运行环境 说明文档 交互体验 准备工作 说明文字 回答方式 宣布文件 执行标准 调查研究""".split()
VERB_MEASURES = """一下 一遍 一回 一次 一趟 一顿 一番 一场 一口 一眼 一手 一脚 一阵 一通 一遭 一程 一下子 一会儿 一回儿
一遍遍""".split()
NEGATED_DEGREES = "不够 不太 不怎么 不大 不是很 不是太 不那么".split()
# Complements behind adverbs.
ADVERBED_COMPLEMENTS = """周到 周全 彻底 到位 全面 完全 充分 深入 细致 严密 严谨 妥善 妥当 得体 利落 麻利 及时 准时 准确 正确
清楚 明白 仔细 认真 努力 用心 严格 坚决 果断 干脆 痛快""".split()
NOUNS_AFTER_PRONOUN = """实现 做法 看法 想法 建议 意见 方案 方式 目标 计划 思路 方法 步骤 结果 效果 成果 进度 质量 标准 规范
要求 需求 设计 架构 代码 逻辑 功能 模块 接口 数据 参数 配置 部署 测试 发布 上线 迭代 重构 优化 修复
Bug 问题 风险 对策""".split()
ADJECTIVES_TAGGED_NOUN = "全面 公平 客观 精准 科学 坦白 高调 消极".split()
# Modifiers that may be attributes of a verbal noun (with ADJECTIVES_TAGGED_NOUN).
ATTRIBUTES = """深入 系统 及时 大力 妥善 集中 反复 逐步 充分 积极 坚决 果断 密切 紧密 合理 灵活 定期 统一 主动 持续
规范 严谨 细致 优雅 高效 稳健 简洁 清晰 明确 专业 标准化 自动化 模块化 快速 缓慢 大胆 小心 谨慎 正确
有效 最好 良好 特别 很大 美好 深刻 清洁 重要 平安 痛苦 最大 成功 全面 完整 严格 详细 进一步""".split()
TECHNICAL_VERBS = """迭代 实现 运行 输出 开发 测量 构建 部署 编译 发布 升级 优化 重构 迁移 集成 扩展 压缩 识别 匹配 验证
同步 监控 检测 评估 审核 分析 研究 设计 规划 管理 处理 存储 传输 转换 提取 生成 分类 预测 推荐 搜索
过滤 配置 调试 维护 计算 统计 翻译 校对 编辑 排版 录制 播放 采集 建模 调度 执行 调整 修订 更新 修改
补充 删除 添加 保存""".split()
# Words that are adverbials whatever their tag.
ADVERBIALS = """开心 快乐 愉快 欣喜 欢喜 甜蜜 舒心 称心 顺心 痛快 尽兴 欣慰 安慰 放心 安心 舒畅 畅快 爽快 高兴 喜悦
欢欣 热情 生气 伤心 难过 愤怒 恼火 烦恼 苦恼 着急 焦急 担心 害怕 恐惧 惊讶 震惊 失望 沮丧 难受 委屈
冤枉 后悔 懊悔 愧疚 自责 内疚 惭愧 羞愧 尴尬 窘迫 认真 仔细 专心 专注 用心 刻苦 努力 拼命 死命 狠命
盲目 随意 随便 随心 任性 肆意 放肆 大胆 胆大 小心 谨慎 细心 耐心 虚心 诚心 诚恳 真心 真诚 全心 全力
尽心 尽力 尽责 负责 认命 安静 大声 兴奋 疯狂 快速 缓慢 急忙 慌忙 悄悄 偷偷 及时 大力 妥善 集中 反复
规范 严谨 细致 深入 系统 模块化 优雅 高效 稳健 简洁 清晰 明确 专业 标准化 自动化 持续集成 持续部署
测试驱动 领域驱动 面向对象 函数式 响应式 声明式 命令式 并发安全 线程安全 幂等 原子性 事务性 最终一致 强一致
可观测 可维护 可扩展 可测试 可复用 可读性 狠狠 用力 使劲 卖力 起劲 认认真真 仔仔细细 踏踏实实 老老实实
规规矩矩 明明白白 清清楚楚 彻彻底底 完完全全 十十足足 严肃认真 一丝不苟 精益求精 兢兢业业 勤勤恳恳 实事求是
无比 主动 恶狠狠 凶狠狠 气呼呼 急匆匆 慌慌张张 慢吞吞 懒洋洋 闲闲散散 悠悠闲闲 静悄悄 偷偷摸摸 鬼鬼祟祟
光明正大 堂堂正正 理直气壮""".split()
# Verbs that may be nouns.
GERUNDS = """配音 剪辑 处理 研究 分析 学习 工作 开发 设计 优化 测试 编程 写作 阅读 思考 调查 讨论 管理 训练 练习
演讲 表演 拍摄 制作 加工 改造 改革 创新 研发 生产 销售 采购 运输 建设 规划 部署 配置 调试 编译 运行
维护 监控 检测 评估 审核 审批 整理 归纳 总结 汇报 沟通 交流 合作 协调 安排 计划 计算 统计 测量 记录
存储 传输 翻译 校对 编辑 排版 录制 播放 采集 生成 提取 转换 压缩 识别 分类 预测 推荐 搜索 排序 过滤
匹配 验证 修复 升级 迁移 备份 恢复 同步 扩展 集成 重构 建模 说明 要求 实现 解释 描述 定义 声明 通知
报告 申请 决定 判断 选择 比较 联系 支持 保护 帮助 指导 教育 培训 监督 检查 审查 观察 实验 实践 应用
使用 利用 创造 发明 改进 完善 提高 提升 降低 减少 增加 扩大 缩小 调整 修订 更新 修改 补充 删除 添加
移动 复制 粘贴 保存 打开 关闭 启动 停止 暂停 继续 完成 结束 开始 反馈 尝试 回顾 预览 预演 演练 审阅
表 了解 认识 旅行 保证 鼓励 折磨 委屈 回忆 成长 出现 交往 相识 治疗""".split()
DETERMINERS = """这个 那个 这 那 这种 那种 这类 那类 这些 那些 这样 那样 一种 一个 一些 很多 许多 不少 每个 任何 某种
整个 全部 所有 一切 各种 本 该 此 某些 若干 大量 大批 一系列 各项 这场 这套 这部分""".split()
# Verbs with a noun object.
OBJECT_VERBS = """开始 进行 继续 结束 负责 完成 需要 开展 加强 深化 推动 支持 实现 落实 实施 执行 启动 推进 展开 从事
抓好 做好 搞好 部署 安排 规划 优化 改进 完善 提高 提升 降低 减少 增加 扩大 缩小 调整 修订 更新 升级
重构 做 提出 提供 给出 接受 经过 通过 听 看 读 写 学 制定 编写 撰写 建立 构建 采用 采取""".split()
# Those of them that may have a verb phrase.
PHRASE_VERBS = "开始 继续 结束 负责 需要 支持 推进".split()
OBJECT_PREPOSITIONS = "经过 通过 根据 随着 为了 按照 由于 基于 围绕 针对 对于 关于".split()
ABSTRACT_HEADS = """能力 经验 态度 水平 质量 效率 技巧 技能 心得 收获 要点 重点 难点 细节 深度 广度 力度 节奏 顺序 步骤
环节 过程 流程 体系 框架 基础 机制 制度 规范 标准 原则 目标 方向 思路 观点 结论 方法 方案 计划 策略
战略 结果 成果 课程 结构 类型 方式 形式 模式 字段 属性 层次 层面""".split()
OBJECT_STARTERS = """这个 那个 这 那 这些 那些 这段 这种 这类 一些 一个 一种 很多 许多 不少 每个 每 各 任何 所有 整个
全部 各种 某些 若干 一 几 两 三""".split()
INNER_FEELINGS = """喜悦 激动 感动 幸福 骄傲 自豪 满足 欣慰 悲伤 痛苦 伤感 惆怅 遗憾 羞愧 羞涩 惊喜 慌乱 恐慌 惊慌 震惊
忐忑""".split()
BODY_SUBJECTS = "脸红 眼红 脸白 手抖 腿软 腰酸 心慌 气短 肚子疼 胃疼 头疼 脑胀 耳热 手心冒汗".split()
