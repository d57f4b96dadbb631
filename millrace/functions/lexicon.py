"""Word lists and patterns of the rule classifier and of span extraction, as configuration."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Lexicon:
    """Keyword lists (order matters for lists of hits) and named patterns; every list may be replaced."""

    vehicle: tuple[str, ...]
    collision: tuple[str, ...]
    accident: tuple[str, ...]
    facility: tuple[str, ...]
    person: tuple[str, ...]
    two_wheeler: tuple[str, ...]
    machinery: tuple[str, ...]
    work_context: tuple[str, ...]
    non_traffic: tuple[str, ...]
    roles: dict[str, str] = field(default_factory=dict)
    pairs: dict[str, str] = field(default_factory=dict)
    events: dict[str, str] = field(default_factory=dict)

    LISTS = ("collision", "accident", "facility", "person", "two_wheeler", "machinery", "work_context", "non_traffic")


# The lists and patterns that results for Korean judgments depend on.
_CARS = "(?:차량|자동차|승용차|화물차|버스|택시|트럭)"
KOREAN = Lexicon(
    vehicle=("차량", "자동차", "승용차", "승합차", "화물차", "버스", "택시", "트럭", "레미콘", "트레일러", "덤프트럭", "냉동탑차", "카고트럭", "승용", "SUV", "지프", "승합"),
    collision=("추돌", "충돌", "접촉", "충격", "들이받", "들이받고", "부딪", "부딪혀", "긁", "스치"),
    accident=("교통사고", "사고", "충돌", "추돌", "접촉", "차선변경", "유턴", "좌회전", "우회전", "직진", "정차", "신호위반"),
    facility=("건물", "벽", "담장", "가드레일", "중앙분리대", "전봇대", "신호등", "구조물", "시설물", "펜스", "연석", "가로수", "방호벽", "교각", "난간"),
    person=("보행자", "행인", "보행 중"),
    two_wheeler=("오토바이", "원동기장치자전거", "이륜차", "자전거", "킥보드"),
    machinery=("크레인", "굴착기", "포크레인", "지게차", "파일드라이버", "항타기", "불도저", "로더"),
    work_context=("작업", "공사", "현장", "하역", "적재", "조립", "신호수", "현장소장", "배달업무"),
    non_traffic=("지급", "투자", "계약", "매매", "도급", "공사대금", "지연손해금", "소장", "송달", "보험금"),
    roles={
        "원고 차량": r"원고\s*(?:의\s*)?(?:차량|차|자동차)", "피고 차량": r"피고\s*(?:의\s*)?(?:차량|차|자동차)",
        "피해 차량": r"피해(?:자)?\s*(?:의\s*)?(?:차량|차|자동차)", "가해 차량": r"가해(?:자)?\s*(?:의\s*)?(?:차량|차|자동차)",
        "상대 차량": r"상대\s*(?:차량|차)", "앞 차량": r"(?:전방|앞)\s*(?:차량|차)", "뒤 차량": r"(?:후방|뒤)\s*(?:차량|차)",
        "피고인 차량": r"피고인\s*(?:의\s*)?(?:차량|차|자동차)",
    },
    pairs={
        "원고/피고 차량": "원고.{0,12}(?:차량|차).{0,24}피고.{0,12}(?:차량|차)|피고.{0,12}(?:차량|차).{0,24}원고.{0,12}(?:차량|차)",
        "피해/가해 차량": "피해.{0,12}(?:차량|차).{0,24}가해.{0,12}(?:차량|차)|가해.{0,12}(?:차량|차).{0,24}피해.{0,12}(?:차량|차)",
        "상대 차량 표현": r"(?:다른|상대|앞서|전방의)\s*(?:차량|차)", "다중 차량 표현": r"(?:1차|2차)\s*충돌|연쇄\s*추돌|다중\s*추돌",
    },
    events={
        "vehicle_to_vehicle_collision_pattern": _CARS + ".{0,35}(?:추돌|충돌|접촉|충격|들이받|부딪).{0,50}(?:다른|상대|피해|가해|원고|피고|전방|앞서)?.{0,20}" + _CARS,
        "vehicle_to_person_pattern": _CARS + ".{0,30}(?:보행자|행인|자전거|오토바이|원동기장치자전거|이륜차)",
        "vehicle_to_facility_pattern": _CARS + ".{0,30}(?:건물|벽|담장|가드레일|중앙분리대|전봇대|신호등|구조물|시설물|펜스|연석|가로수|방호벽|교각|난간)",
        "work_accident_pattern": "(?:크레인|굴착기|포크레인|지게차|파일드라이버|항타기|불도저|로더).{0,40}(?:작업|공사|현장|하역|적재|조립)",
    },
)

#: The same machine on the invented prose of ``documents``, where the Korean terms never occur.
PROSE = Lexicon(
    vehicle=("the ", "and ", "der ", "que ", "des "),
    collision=("tion", "ment", "keit", "ción", "ing"),
    accident=("ation", "sch", "eau", "ent", "ion"),
    facility=("License", "licensed"),
    person=("idiot", "trash", "clown"),
    two_wheeler=("AKIA", "password"),
    machinery=("$$$", "%%%"),
    work_context=("###", "***"),
    non_traffic=("!!", " | "),
    roles={"article": r"the\s+of", "und": r"und\s+der", "et": r"et\s+de", "que": r"que\s+la"},
    pairs={"of the": "of.{0,12}the.{0,24}and", "de la": "de.{0,12}la.{0,24}le", "the or": r"(?:for|with)\s+the"},
    events={
        "vehicle_to_vehicle_collision_pattern": "(?:the|der|que|des) .{0,35}(?:tion|keit|ción|ment).{0,50}(?:the|der|que|des) ",
        "vehicle_to_person_pattern": "(?:the|der|que|des) .{0,30}(?:idiot|trash|clown)",
        "vehicle_to_facility_pattern": "(?:the|der|que|des) .{0,30}(?:License|licensed)",
        "work_accident_pattern": r"(?:\$\$\$|%%%).{0,40}(?:###|\*\*\*)",
    },
)

#: Fields of a record whose text is analysed, in order.
RECORD_FIELDS = ("source_text", "accident_trajectory", "vehicle_type", "location", "road_type", "weather_or_environment")
