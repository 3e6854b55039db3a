"""Word lists as parameters: a lexicon maps keywords to weights by category.

A keyword lexicon is data, not code: give it as a mapping or a file (``read_lexicon``). The short lists
below are fixed values that results depend on.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

# Weight of each keyword category.
CATEGORY_WEIGHTS = {
    "核心词": 1.5, "方法词": 1.5, "效果词": 3.0, "相关词": 2.5, "网络用语": 3.0, "产品词": 3.0,
    "健康指标": 1.5, "心理行为": 3.0, "反减肥词": 2.5, "心理健康词": 2.2, "医疗干预词": 2.0, "社会文化词": 1.8,
}
# Fixed value: the category whose keywords count towards the second way of being related.
CONTRARY_CATEGORY = "反减肥词"
# Phrases that are removed from every text.
REMOVED = [
    "封面新闻记者", "许敏", "编辑", "红星新闻记者", "责编", "李彬彬", "雷军", "我们尊重原创也注重分享", "李桐杉", "赵鹏", "图片来源", "发布于广东省",
    "the end", "来源中国疾控中心", "杨一兵司向高欣", "责任编辑", "胡伊文", "版权原作者所有如在使用信息时侵犯了您的利益请及时联系我们将在24小时之内删除",
    "来源中国新闻社综合自中国新闻网红星新闻21世纪经济报道九派新闻大众日报", "哪吒", "邮箱地址jpbl",
    "新政府或将提前释放囚犯", "3上半年进出口规模历史同期首次突破20万亿元我国外贸展现较强韧性", "4德国宣布移除5g网络中国通信企业组件我使馆坚决反对",
]
# A text with one of these is unrelated.
EXCLUDED = [
    "医疗器械", "医疗设备", "患者", "医疗器械注册",
    "招聘", "就业", "求职", "薪资", "面试", "简历", "职位", "工作", "感情戏",
    "宠物", "猫", "狗", "动物", "宠物食品", "兽医", "考试", "战役纪念", "爱国主义",
    "骨质疏松症", "骨密度", "补钙", "骨骼健康", "骨骼", "乡村", "创业", "早安", "学无止境",
    "贷款", "信用卡", "投资", "理财", "保险", "股票", "基金", "证券",
    "银行", "支付", "转账", "收款", "提现", "退款", "押金", "保证金",
]
# Words that term counts leave out.
STOP_WORDS = [
    "的", "了", "在", "是", "我", "有", "和", "就", "不", "人",
    "都", "一", "一个", "上", "也", "很", "到", "说", "要", "去",
    "你", "会", "着", "没有", "看", "好", "自己", "这", "但", "这个",
    "可以", "这样", "啊", "吗", "呢", "吧", "哈哈",
]
# Words that the segmenter keeps whole.
SEGMENT_WORDS = ["体重管理", "减肥", "减脂", "瘦身", "BMI", "体脂率", "平台期", "热量缺口", "基础代谢", "轻断食", "生酮", "碳水循环"]
# Words of good and bad feeling.
POSITIVE = ["成功", "瘦了", "开心", "满意", "有效", "推荐", "坚持"]
NEGATIVE = ["失败", "反弹", "放弃", "痛苦", "饿", "没用", "骗人"]
# Word lists of the behaviour scores.
BEHAVIOUR = {
    "complex": ["计算", "公式", "科学", "研究", "数据", "测量", "记录", "营养素", "宏量"],
    "simple": ["就是", "只要", "直接", "简单", "轻松", "一招", "秘诀"],
    "long_term": ["坚持", "长期", "习惯", "一辈子", "终身", "循序渐进", "慢慢", "稳定"],
    "short_term": ["快速", "三天", "一周", "速成", "暴瘦", "月瘦", "立竿见影", "马上"],
    "product": ["药", "代餐", "产品", "购买", "链接", "店铺", "品牌", "推荐款", "司美格鲁肽", "奥利司他", "酵素", "左旋肉碱", "仪器", "肽"],
    "scientific": ["研究", "证明", "科学", "医生", "论文", "实验", "证据", "原理", "热量", "蛋白质", "碳水", "代谢", "基础代谢", "BMI", "体脂率"],
    "unscientific": ["排毒", "宿便", "清肠", "酸碱", "负卡", "燃脂", "神奇"],
    "positive": ["成功", "有效", "推荐", "开心", "满意", "瘦了", "健康"],
    "negative": ["失败", "反弹", "放弃", "痛苦", "焦虑", "没用", "骗人"],
    "social": ["打卡", "互相监督", "减肥搭子", "一起", "组队", "分享", "晒"],
    "data": ["数据", "记录", "App", "称重", "测量", "监测", "追踪"],
    "guidance": ["教练", "营养师", "医生", "专业", "指导", "咨询", "定制"],
}
# Words that point to a strategy's name; a word that stands twice counts twice.
STRATEGY_PATTERNS = {
    "运动主导型": [
        "运动", "健身", "跑步", "锻炼", "健身房", "撸铁", "力量训练", "增肌减脂", "HIIT", "有氧运动",
        "跑步", "游泳", "瑜伽", "普拉提", "私教", "训练计划", "习惯养成",
        "运动消耗", "卡路里消耗", "运动打卡", "管住嘴迈开腿", "运动",
    ],
    "饮食控制型": [
        "饮食", "节食", "卡路里", "热量", "热量缺口", "轻断食", "生酮饮食", "低碳饮食", "碳水循环", "均衡饮食",
        "饮食记录", "卡路里计算", "营养配比", "餐盘法则", "长期坚持", "习惯养成",
        "控糖", "低GI", "膳食纤维", "饱腹感", "戒糖", "控油", "生活方式", "饮食",
    ],
    "医学干预型": [
        "医生", "药物", "手术", "治疗", "司美格鲁肽", "GLP-1", "减肥针", "二甲双胍", "奥利司他",
        "医生建议", "内分泌科", "营养科", "肥胖门诊", "医学减重",
        "处方药", "药物辅助", "医疗监督", "肽",
    ],
    "特殊人群适配型": [
        "孕妇", "老人", "糖尿病", "术后", "产后", "哺乳期", "中老年", "学生",
        "上班族", "久坐", "PCOS", "甲减", "代谢慢", "易胖体质",
        "体质调理", "内分泌调节",
    ],
    "技术量化型": [
        "app", "数据", "监测", "打卡", "BMI", "体脂率", "基础代谢", "TDEE", "热量计算器",
        "体重秤", "智能秤", "App记录", "数据追踪", "体重曲线",
        "围度测量", "体成分分析", "科学监测",
    ],
    "创新方法型": ["新方法", "创新", "研究发现", "个性化", "创新体重管理", "创新", "新方式"],
}
# Words in a strategy's name and its cost, in the order of the rules.
COST_RULES = [
    (["科学", "健康", "营养", "均衡"], 0.5),
    (["快速", "捷径", "药"], 0.1),
    (["心理", "焦虑", "调适"], 0.3),
    (["放弃", "躺平", "佛系"], 0.2),
    (["运动", "健身", "锻炼"], 0.4),
]
DEFAULT_COST = 0.3


@dataclass(frozen=True)
class Lexicon:
    """Keywords in the order of their first appearance, with weights; ``contrary`` is a set of them."""

    keywords: tuple[str, ...]
    weights: tuple[float, ...]
    contrary: tuple[str, ...] = ()

    @classmethod
    def of(cls, categories: Mapping[str, Iterable[str]], weights: Mapping[str, float] = CATEGORY_WEIGHTS, contrary: str = CONTRARY_CATEGORY) -> Lexicon:
        """A keyword in several categories has the last one's weight and its first place; an unknown category weighs 1."""
        flat: dict[str, float] = {}
        for category, words in categories.items():
            for w in words:
                flat[w] = float(weights.get(category, 1.0))
        return cls(tuple(flat), tuple(flat.values()), tuple(dict.fromkeys(categories.get(contrary, ()))))


def read_lexicon(path: str, weights: Mapping[str, float] = CATEGORY_WEIGHTS) -> Lexicon:
    """A JSON object from category to list of keywords."""
    with open(path, encoding="utf-8") as f:
        return Lexicon.of(json.load(f), weights)
