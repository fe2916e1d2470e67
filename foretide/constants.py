"""Stages, weights, limits, word lists and patterns that decide results. Nothing here is derived."""

from __future__ import annotations

# --- stages, in order -------------------------------------------------------------------------------------------
STAGES = ("council_mention", "budget_line", "order_plan", "prespec", "bid_notice", "award")
PRE_PROCUREMENT = ("council_mention", "budget_line")
BID_LAG_DAYS = {
    "council_mention": (180, 540), "budget_line": (60, 300), "order_plan": (20, 150),
    "prespec": (7, 45), "bid_notice": (0, 0), "award": (0, 0),
}
STAGE_PRIOR = {"council_mention": 0.35, "budget_line": 0.7, "order_plan": 0.85, "prespec": 0.95, "bid_notice": 1.0, "award": 1.0}
COMMITMENT_MULTIPLIER = {"committed": 1.6, "planned": 1.2, "reviewing": 0.6, "declined": 0.15}
COMMITMENT_RANK = {"declined": 0, "reviewing": 1, "planned": 2, "committed": 3}

# --- linking ----------------------------------------------------------------------------------------------------
LINK_WEIGHTS = {"semantic": 0.35, "title": 0.30, "category": 0.15, "budget": 0.10, "timeline": 0.10}
LINK_CONFLICT, LINK_EXCLUSIVE, LINK_THRESHOLD, LINK_BAND = 0.15, 0.2, 0.60, 0.08
SPAN_DAYS, NAME_FLOOR, SAME_BUDGET, SAME_TIME = 720, 0.5, 0.85, 0.9
BID_OPEN_DAYS, DORMANT_DAYS, OVERDUE_DAYS = 21, 540, 180

# --- recommending -----------------------------------------------------------------------------------------------
RECOMMEND_WEIGHTS = {"semantic": 0.26, "keyword": 0.22, "category": 0.12, "region": 0.08, "budget": 0.08, "conversion": 0.14, "lead_time": 0.10}
EXCLUDED_FACTOR, PER_SOURCE, PER_ORG = 0.2, 300, 150

# --- triage -----------------------------------------------------------------------------------------------------
TRIAGE = {"bias": -2.4, "procurement_verbs": 0.55, "category_keywords": 0.6, "commitment": 1.3, "amount": 1.1, "future": 0.45, "noise": -0.9, "budget_line": 1.6}
TRIAGE_CAPS = {"procurement_verbs": 3, "category_keywords": 3, "commitment": 2, "future": 2, "noise": 2}
TRIAGE_THRESHOLD = 0.35
FUTURE_MARKERS = ("내년", "내후년", "예정", "계획", "하반기", "상반기", "본예산", "추경", "년도")
PROCUREMENT_VERBS = (
    "구축", "도입", "설치", "조성", "추진", "용역", "발주", "사업비", "예산", "반영",
    "편성", "시범사업", "확대", "교체", "고도화", "구매", "임차", "공모", "착수", "계약",
)
NOISE_MARKERS = (
    "의사일정", "성원이 되었", "개의를 선포", "산회를 선포", "정회를 선포", "의석을 정돈", "회의록 서명",
    "감사합니다", "수고하셨습니다", "속기", "(의사봉",
)
COMMITMENTS = {
    "committed": ("반영하였", "반영했", "편성하였", "편성했", "확보하였", "확보했", "발주할 예정", "발주 예정", "추진하겠습니다",
                  "반영하겠습니다", "편성하겠습니다", "착수할 예정", "확정"),
    "planned": ("계획입니다", "계획하고 있", "예정입니다", "추진할 계획", "준비하고 있", "추진 중", "하반기", "내년도", "본예산에", "추경에"),
    "reviewing": ("검토하겠습니다", "검토해 보겠습니다", "검토하도록", "적극 검토", "살펴보겠습니다", "협의하겠습니다", "고민하겠습니다", "연구용역"),
    "declined": ("어렵습니다", "곤란합니다", "어려운 실정", "추진하지 않", "보류", "불가"),
}

# --- categories, in order ---------------------------------------------------------------------------------------
CATEGORIES = {
    "smart_city": ("스마트시티", "스마트쉘터", "스마트 쉘터", "스마트정류장", "스마트 정류장", "IoT", "사물인터넷", "스마트폴",
                   "스마트 폴", "디지털트윈", "디지털 트윈", "도시통합플랫폼", "스마트 가로등", "스마트가로등", "스마트 횡단보도", "스마트횡단보도"),
    "safety_cctv": ("CCTV", "씨씨티비", "선별관제", "지능형 관제", "방범", "통합관제", "재난", "안전", "침수", "비상벨",
                    "어린이보호구역", "스쿨존", "산불감시"),
    "public_sw": ("정보시스템", "시스템 구축", "고도화", "홈페이지", "누리집", "챗봇", "민원", "클라우드", "전환", "행정",
                  "모바일 앱", "전자", "플랫폼 구축", "유지관리"),
    "ai_data": ("인공지능", "AI", "빅데이터", "데이터", "분석", "예측", "상권분석", "머신러닝", "데이터 허브", "데이터허브", "대시보드"),
    "mobility": ("주차", "교통", "버스", "DRT", "수요응답", "공유", "킥보드", "모빌리티", "신호", "주차정보", "전기차 충전", "충전소"),
    "energy_env": ("태양광", "에너지", "탄소", "LED", "미세먼지", "환경", "수소", "재생에너지", "기후", "그린", "폐기물", "공기청정"),
    "welfare_care": ("돌봄", "독거", "어르신", "고독사", "복지", "치매", "장애인", "AI 스피커", "인공지능 스피커", "건강관리", "보건소", "노인"),
    "education": ("교육", "학교", "디지털 배움터", "메이커", "코딩", "평생학습", "도서관", "청소년", "에듀테크"),
    "tourism_culture": ("관광", "축제", "미디어파사드", "미디어 파사드", "메타버스", "야간관광", "문화", "전시", "콘텐츠", "XR", "실감"),
    "facility": ("리모델링", "증축", "신축", "공사", "보수", "정비", "건립", "조성공사", "개보수", "설계"),
    "other": (),
}
GENERIC_KEYWORDS = (
    "시스템 구축", "플랫폼 구축", "고도화", "전환", "데이터", "분석", "안전", "행정", "전자", "유지관리",
    "공사", "설계", "문화", "공유", "신호", "그린", "환경",
)

# --- synonyms: the first of each group is the canonical form -------------------------------------------------------
SYNONYMS = (
    ("어린이보호구역", "스쿨존", "학교 앞"),
    ("스마트쉘터", "스마트 쉘터", "스마트 버스정류장", "스마트버스정류장", "스마트정류장", "스마트 정류장"),
    ("수요응답형교통", "수요응답형 교통", "수요응답형", "수요응답", "DRT", "부르면 오는 버스"),
    ("태양광", "신재생에너지", "재생에너지", "신재생 에너지"),
    ("인공지능", "AI"),
    ("누리집", "홈페이지"),
    ("예경보", "예·경보", "예측·경보", "예측 경보", "경보"),
    ("CCTV", "안전카메라", "씨씨티비", "단속카메라"),
    ("챗봇", "AI 상담", "상담봇"),
    ("돌봄스피커", "돌봄 스피커", "AI 스피커", "인공지능 스피커", "돌봄서비스", "돌봄 서비스"),
    ("메이커스페이스", "메이커 스페이스"),
    ("미디어파사드", "미디어 파사드"),
    ("주차안내", "주차정보 안내", "주차 안내", "주차정보안내"),
    ("디지털트윈", "디지털 트윈", "3D 디지털트윈", "3차원 디지털트윈"),
    ("리모델링", "개보수", "리노베이션"),
    ("전기차충전", "전기차 충전", "급속충전기", "충전소", "충전기", "충전인프라"),
    ("침수", "하천 수위", "수위"),
    ("클라우드전환", "클라우드 전환", "클라우드 네이티브", "클라우드 이전"),
    ("고독사", "안부확인", "안부 확인"),
    ("상권분석", "상권 분석", "골목상권"),
    ("가로등", "LED 가로등", "스마트 가로등"),
    ("선별관제", "지능형 관제", "지능형 선별관제"),
    ("스마트폴", "스마트 폴", "스마트 기둥"),
)

# --- money, time ------------------------------------------------------------------------------------------------
SMALL_UNITS = {"십": 10, "백": 100, "천": 1000}
LARGE_UNITS = {"만": 10**4, "억": 10**8, "조": 10**12}
HANGUL_DIGITS = {"영": 0, "공": 0, "일": 1, "이": 2, "삼": 3, "사": 4, "오": 5, "육": 6, "륙": 6, "칠": 7, "팔": 8, "구": 9}
TABLE_UNITS = {"원": 1, "천원": 1000, "만원": 10**4, "백만원": 10**6, "억원": 10**8}
RELATIVE_YEARS = (
    ("내후년", 2), ("다다음 해", 2), ("내년", 1), ("다음 연도", 1), ("다음연도", 1), ("명년", 1), ("차년도", 1),
    ("올해", 0), ("금년", 0), ("당해", 0), ("연내", 0), ("올 하반기", 0),
)

# --- evaluation, evidence, chunks ---------------------------------------------------------------------------------
HORIZON_DAYS, LEAST_SAMPLES = 540, 5
UNCERTAIN_DATES = ("fiscal_year", "last_modified", "crawled", "meeting_date")
QUOTE_SCORE, QUOTE_CHARS, OFFICIAL_CHARS, AMOUNT_TOLERANCE, LOW_CONFIDENCE = 88, 4, 12, 0.01, 0.4
MAX_CHUNK, HANDOVER_CHARS, PLAIN_SIZE, PLAIN_OVERLAP = 2400, 80, 1500, 200
FUZZY_SCORE, FUZZY_LEAD = 90, 4
